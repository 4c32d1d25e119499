"""The registered queries again, as plain SQL over the shared test tables."""

from __future__ import annotations

EPSILON = "1e-10"


def num(expression: str) -> str:
    """Rounded double. The shift moves means that end in a half away from the rounding edge."""
    return f"(round(CAST({expression} AS DOUBLE) + {EPSILON}, 6) + 0.0)"


# Labels of the event root codes, and continents of country codes.
LABELS = """('01', 'Declaraciones públicas'), ('02', 'Apelaciones'), ('03', 'Expresar intención'), ('04', 'Consultar'),
  ('05', 'Diplomacia'), ('06', 'Cooperar materialmente'), ('07', 'Dar ayuda'), ('08', 'Ceder'), ('09', 'Investigar'),
  ('10', 'Exigir'), ('11', 'Rechazar'), ('12', 'Acusar'), ('13', 'Amenazar'), ('14', 'Protestas'), ('15', 'Obstruir'),
  ('16', 'Coerción'), ('17', 'Asalto'), ('18', 'Ataque'), ('19', 'Violencia masiva'), ('20', 'Uso de armas no convencionales')"""
PLACES = """('US', 'Americas'), ('CA', 'Americas'), ('MX', 'Americas'), ('BR', 'Americas'), ('UK', 'Europe'), ('FR', 'Europe'),
  ('GM', 'Europe'), ('RS', 'Europe'), ('CH', 'Asia'), ('IN', 'Asia'), ('JA', 'Asia'), ('NI', 'Africa'), ('SF', 'Africa'),
  ('EG', 'Africa'), ('AS', 'Oceania')"""


NEWS_EVENTS = """news_events AS (
  SELECT e.event_id AS GlobalEventID, CAST(substr(stamp, 1, 8) AS INTEGER) AS "Day",
    CASE WHEN k % 10 = 0 THEN NULL ELSE n1.n_name END AS Actor1CountryCode,
    CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN '' ELSE 'ETH' || (k % 8) END AS Actor1EthnicCode,
    CASE WHEN k % 3 = 0 THEN NULL ELSE 'REL' || (k % 4) END AS Actor1Religion1Code,
    CASE WHEN k % 6 = 0 THEN NULL ELSE upper(event_type) END AS Actor1Type1Code,
    CASE WHEN k % 11 = 0 THEN NULL ELSE n2.n_name END AS Actor2CountryCode,
    CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN '' ELSE 'ETH' || (k % 8) END AS Actor2EthnicCode,
    CASE WHEN k % 2 = 0 THEN NULL ELSE 'REL' || (k % 6) END AS Actor2Religion1Code,
    CASE WHEN k % 7 = 0 THEN NULL ELSE 'T' || (k % 5) END AS Actor2Type1Code,
    lpad(CAST(1 + k % 20 AS VARCHAR), 2, '0') AS EventRootCode,
    CAST(1 + e.event_id % 4 AS INTEGER) AS QuadClass,
    CAST(k - 50 AS DOUBLE) / 5.0 AS GoldsteinScale,
    1 + k % 10 AS NumMentions, 1 + k % 7 AS NumSources, 1 + k % 13 AS NumArticles,
    10 - e.value / 10 AS AvgTone,
    event_type || ', ' || n1.n_name AS ActionGeo_FullName,
    n1.n_name AS ActionGeo_CountryCode, stamp AS DATEADDED,
    coalesce(r.r_name, 'Other') AS region, e.ts AS ts
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
               strftime(ts, '%Y%m%d%H%M%S') AS stamp FROM events) e
  JOIN customer c ON e.user_id = c.c_custkey
  JOIN nation n1 ON c.c_nationkey = n1.n_nationkey
  JOIN nation n2 ON n2.n_nationkey = e.k % 25
  LEFT JOIN region r ON r.r_regionkey = n1.n_regionkey AND r.r_name <> 'ASIA')"""

MENTIONS = """mentions AS (
  SELECT CAST(CASE WHEN k < 30 THEN k % 2 ELSE k END AS BIGINT) AS GlobalEventID,
    make_timestamp(CAST((1704067200 + floor((epoch(date_trunc('second', ts)) - 1704067200) / 72)) * 1000000 AS BIGINT)) AS seen,
    CASE WHEN k = 99 THEN NULL ELSE 'src' || (user_id % 20) END AS MentionSourceName
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""

GKG = """gkg AS (
  SELECT CAST(doc_id AS VARCHAR) AS GKGRECORDID, (2022 + doc_id % 3) || '01' || lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0') || '000000' AS stamp,
    source || '; ' || lang || ';;org' || (doc_id % 7) AS Organizations,
    'LANG_' || upper(lang) || ',' || n_chars || ';TOPIC_' || (doc_id % 12) || ',5;' AS V2Themes,
    CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 9 = 1 THEN 'junk' ELSE '1#Place, X#' ||
      CASE doc_id % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'FR' WHEN 2 THEN 'CH' ELSE 'ZZ' END || '#A#B#1#2#3' END AS V2Locations
  FROM documents)"""

COUNTRY_DAY = """daily AS (
  SELECT ActionGeo_CountryCode AS country, CAST(substr(DATEADDED, 1, 8) AS INTEGER) AS date,
    count(GlobalEventID) AS events, avg(AvgTone) AS tone,
    sum(CASE WHEN QuadClass >= 3 THEN 1 ELSE 0 END) AS conflicts
  FROM news_events WHERE ActionGeo_CountryCode IS NOT NULL GROUP BY 1, 2)"""

HOURLY = """hourly AS (
  SELECT GlobalEventID, date_trunc('hour', seen) AS mention_hour, count(*) AS n FROM mentions GROUP BY 1, 2)"""

BURSTS = """bursts AS (
  SELECT m.GlobalEventID, f.first_at, count(*) AS n
  FROM mentions m JOIN (SELECT GlobalEventID, min(seen) AS first_at FROM mentions GROUP BY 1) f
    ON m.GlobalEventID = f.GlobalEventID AND m.seen <= f.first_at + INTERVAL 1 HOUR
  GROUP BY 1, 2 HAVING count(*) >= 100)"""

# Result set: needed relations, and its rows with exact doubles and timestamps.
RESULTS: dict[str, tuple[tuple[str, ...], str]] = {
    "conflict_heatmap": ((NEWS_EVENTS,), """
        SELECT ActionGeo_CountryCode AS country, CAST(substr(DATEADDED, 1, 8) AS INTEGER) AS date,
          avg(GoldsteinScale) AS avg_goldstein, count(GlobalEventID) AS event_count, avg(NumMentions) AS avg_mentions
        FROM news_events WHERE QuadClass >= 3 AND ActionGeo_CountryCode IS NOT NULL GROUP BY 1, 2"""),
    "top_news_countries": ((NEWS_EVENTS, COUNTRY_DAY), """
        SELECT country, date, event_count, rank FROM (
          SELECT country, date, events AS event_count,
            CAST(rank() OVER (PARTITION BY date ORDER BY events DESC) AS INTEGER) AS rank FROM daily)
        WHERE rank <= 10"""),
    "tone_source_correlation": ((NEWS_EVENTS,), """
        SELECT ActionGeo_CountryCode AS country, CAST(substr(DATEADDED, 1, 8) AS INTEGER) AS date,
          avg(AvgTone) AS avg_tone, avg(NumSources) AS avg_sources,
          covar_pop(AvgTone, NumSources) / nullif(stddev_pop(AvgTone) * stddev_pop(NumSources), 0) AS tone_sources_correlation,
          count(GlobalEventID) AS sample_size
        FROM news_events WHERE AvgTone IS NOT NULL AND NumSources IS NOT NULL AND ActionGeo_CountryCode IS NOT NULL
        GROUP BY 1, 2"""),
    "cameo_distribution": ((NEWS_EVENTS,), f"""
        SELECT EventRootCode, event_description, region, CAST(substr(DATEADDED, 1, 8) AS INTEGER) AS date,
          count(GlobalEventID) AS event_count
        FROM news_events LEFT JOIN (VALUES {LABELS}) AS labels(code, event_description)
          ON EventRootCode = code
        WHERE EventRootCode IS NOT NULL AND ActionGeo_CountryCode IS NOT NULL GROUP BY 1, 2, 3, 4"""),
    "actor_interaction_matrix": ((NEWS_EVENTS,), """
        SELECT Actor1Type1Code AS actor1_type, Actor2Type1Code AS actor2_type, count(GlobalEventID) AS event_count,
          avg(GoldsteinScale) AS avg_goldstein, avg(AvgTone) AS avg_tone
        FROM news_events WHERE Actor1Type1Code IS NOT NULL AND Actor2Type1Code IS NOT NULL GROUP BY 1, 2"""),
    "media_coverage_ratio": ((NEWS_EVENTS,), """
        SELECT ActionGeo_CountryCode AS country, "Day" AS date, CAST(sum(NumMentions) AS BIGINT) AS total_mentions,
          count(GlobalEventID) AS total_events,
          CAST(sum(NumMentions) AS DOUBLE) / count(GlobalEventID) AS mentions_per_event
        FROM news_events WHERE ActionGeo_CountryCode IS NOT NULL GROUP BY 1, 2"""),
    "sentiment_trend": ((NEWS_EVENTS, COUNTRY_DAY), """
        SELECT country, date, tone AS avg_tone, avg(tone) OVER (
            PARTITION BY country ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS moving_avg_3d
        FROM daily"""),
    "conflict_pairs": ((NEWS_EVENTS,), """
        SELECT Actor1CountryCode AS actor1_country, Actor2CountryCode AS actor2_country, "Day" AS date,
          count(GlobalEventID) AS conflict_count, avg(GoldsteinScale) AS avg_goldstein
        FROM news_events WHERE QuadClass >= 3 AND Actor1CountryCode <> Actor2CountryCode GROUP BY 1, 2, 3"""),
    "escalation_events": ((MENTIONS, HOURLY), """
        SELECT GlobalEventID, mention_hour, mentions_last_24h, n AS mentions_this_hour,
          CAST(n AS DOUBLE) / (mentions_last_24h + 1) AS escalation_ratio
        FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY GlobalEventID ORDER BY mention_hour
                ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS BIGINT) AS mentions_last_24h FROM hourly)
        WHERE CAST(n AS DOUBLE) / (mentions_last_24h + 1) > 0.5"""),
    "religion_conflict_cluster": ((NEWS_EVENTS,), """
        SELECT coalesce(Actor1Religion1Code, Actor2Religion1Code) AS religion, region,
          CAST(substr(DATEADDED, 1, 8) AS INTEGER) AS date,
          count(GlobalEventID) AS event_count, avg(GoldsteinScale) AS avg_goldstein
        FROM news_events WHERE QuadClass >= 3 AND coalesce(Actor1Religion1Code, Actor2Religion1Code) <> ''
        GROUP BY 1, 2, 3"""),
    "gkg_themes_continent": ((GKG,), f"""
        SELECT theme, continent, "year", mention_count, rank FROM (
          SELECT *, CAST(rank() OVER (PARTITION BY continent, "year" ORDER BY mention_count DESC) AS INTEGER) AS rank
          FROM (SELECT theme, coalesce(continent, 'Unknown') AS continent, "year", count(*) AS mention_count
            FROM (SELECT substr(stamp, 1, 4) AS "year", regexp_extract(V2Locations, '#([A-Z]{{2}})#', 1) AS code,
                    split_part(split_part(unnest(string_split(V2Themes, ';')), '#', 1), ',', 1) AS theme
                  FROM gkg WHERE V2Themes <> '') t
            LEFT JOIN (VALUES {PLACES}) AS places(place, continent) ON t.code = place
            WHERE theme <> '' GROUP BY 1, 2, 3))
        WHERE rank <= 10"""),
    "top_organizations": ((GKG,), """
        SELECT organization, date, mention_count, rank FROM (
          SELECT *, CAST(rank() OVER (PARTITION BY date ORDER BY mention_count DESC) AS INTEGER) AS rank
          FROM (SELECT organization, date, count(*) AS mention_count
            FROM (SELECT trim(unnest(string_split(Organizations, ';'))) AS organization, substr(stamp, 1, 8) AS date
                  FROM gkg WHERE Organizations <> '')
            WHERE organization <> '' GROUP BY 1, 2))
        WHERE rank <= 20"""),
    "tone_conflict_lag": ((NEWS_EVENTS, COUNTRY_DAY), """
        SELECT t.country, t.date, t.tone AS today_avg_tone, CAST(t.conflicts AS BIGINT) AS today_conflict_count,
          CAST(n.conflicts AS BIGINT) AS tomorrow_conflict_count
        FROM daily t LEFT JOIN daily n ON t.country = n.country
          AND strptime(CAST(n.date AS VARCHAR), '%Y%m%d') = strptime(CAST(t.date AS VARCHAR), '%Y%m%d') + INTERVAL 1 DAY"""),
    "diplomatic_network": ((NEWS_EVENTS,), """
        SELECT Actor1CountryCode AS source_country, Actor2CountryCode AS target_country,
          CAST(sum(CASE WHEN QuadClass <= 2 THEN 1 ELSE 0 END) AS BIGINT) AS diplomatic_count,
          CAST(sum(CASE WHEN QuadClass >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS conflict_count,
          count(GlobalEventID) AS total_interactions
        FROM news_events WHERE Actor1CountryCode <> Actor2CountryCode GROUP BY 1, 2"""),
    "source_diversity_index": ((NEWS_EVENTS, MENTIONS), """
        SELECT ActionGeo_CountryCode AS country, "Day" AS date, count(DISTINCT MentionSourceName) AS unique_sources,
          count(*) AS total_mentions, ln(count(DISTINCT MentionSourceName) + 1) AS source_diversity_index
        FROM mentions JOIN news_events USING (GlobalEventID)
        WHERE ActionGeo_CountryCode IS NOT NULL AND MentionSourceName IS NOT NULL GROUP BY 1, 2"""),
    "ethnic_conflicts": ((NEWS_EVENTS,), """
        SELECT ethnicity, date, CAST(sum(n) AS BIGINT) AS event_count, avg(g) AS avg_goldstein
        FROM (SELECT Actor1EthnicCode AS ethnicity, "Day" AS date, count(GlobalEventID) AS n, avg(GoldsteinScale) AS g
              FROM news_events WHERE QuadClass >= 3 AND Actor1EthnicCode <> '' GROUP BY 1, 2
              UNION ALL
              SELECT Actor2EthnicCode, "Day", count(GlobalEventID), avg(GoldsteinScale)
              FROM news_events WHERE QuadClass >= 3 AND Actor2EthnicCode <> '' GROUP BY 1, 2)
        GROUP BY 1, 2"""),
    "breaking_news": ((NEWS_EVENTS, MENTIONS, BURSTS), """
        SELECT b.GlobalEventID, b.first_at AS first_mention_time, b.n AS mentions_in_first_hour,
          e.ActionGeo_CountryCode AS country, e."Day" AS date
        FROM bursts b LEFT JOIN news_events e USING (GlobalEventID)"""),
    "extreme_tone_events": ((NEWS_EVENTS,), """
        SELECT GlobalEventID, ActionGeo_CountryCode AS country, ActionGeo_FullName, EventRootCode, QuadClass, AvgTone,
          NumMentions, "Day", 'most_negative' AS tone_extreme_type
        FROM (SELECT * FROM news_events WHERE AvgTone IS NOT NULL ORDER BY AvgTone, GlobalEventID LIMIT 15)
        UNION ALL
        SELECT GlobalEventID, ActionGeo_CountryCode, ActionGeo_FullName, EventRootCode, QuadClass, AvgTone,
          NumMentions, "Day", 'most_positive'
        FROM (SELECT * FROM news_events WHERE AvgTone IS NOT NULL ORDER BY AvgTone DESC, GlobalEventID LIMIT 15)"""),
    "top_article_coverage": ((NEWS_EVENTS,), """
        SELECT ActionGeo_CountryCode AS country, CAST(sum(NumArticles) AS BIGINT) AS total_articles,
          avg(NumArticles) AS avg_articles_per_event, count(GlobalEventID) AS event_count
        FROM news_events WHERE ActionGeo_CountryCode IS NOT NULL AND NumArticles IS NOT NULL GROUP BY 1"""),
}

# Columns of each result set, doubles and timestamps marked.
COLUMNS = {
    "conflict_heatmap": "country date avg_goldstein:d event_count avg_mentions:d",
    "top_news_countries": "country date event_count rank",
    "tone_source_correlation": "country date avg_tone:d avg_sources:d tone_sources_correlation:d sample_size",
    "cameo_distribution": "EventRootCode event_description region date event_count",
    "actor_interaction_matrix": "actor1_type actor2_type event_count avg_goldstein:d avg_tone:d",
    "media_coverage_ratio": "country date total_mentions total_events mentions_per_event:d",
    "sentiment_trend": "country date avg_tone:d moving_avg_3d:d",
    "conflict_pairs": "actor1_country actor2_country date conflict_count avg_goldstein:d",
    "escalation_events": "GlobalEventID mention_hour:t mentions_last_24h mentions_this_hour escalation_ratio:d",
    "religion_conflict_cluster": "religion region date event_count avg_goldstein:d",
    "gkg_themes_continent": "theme continent year mention_count rank",
    "top_organizations": "organization date mention_count rank",
    "tone_conflict_lag": "country date today_avg_tone:d today_conflict_count tomorrow_conflict_count",
    "diplomatic_network": "source_country target_country diplomatic_count conflict_count total_interactions",
    "source_diversity_index": "country date unique_sources total_mentions source_diversity_index:d",
    "ethnic_conflicts": "ethnicity date event_count avg_goldstein:d",
    "breaking_news": "GlobalEventID first_mention_time:t mentions_in_first_hour country date",
    "extreme_tone_events": "GlobalEventID country ActionGeo_FullName EventRootCode QuadClass AvgTone:d NumMentions Day tone_extreme_type",
    "top_article_coverage": "country total_articles avg_articles_per_event:d event_count",
}


def shown(columns: str) -> str:
    """Select list that rounds doubles and prints timestamps."""
    out = []
    for item in columns.split():
        name, _, mark = item.partition(":")
        if mark == "d":
            out.append(f'{num(name)} AS "{name}"')
        elif mark == "t":
            out.append(f"""strftime({name}, '%Y-%m-%d %H:%M:%S') AS "{name}\"""")
        else:
            out.append(f'"{name}"')
    return ", ".join(out)


def query(relations: tuple[str, ...], body: str, columns: str) -> str:
    return f"WITH {', '.join(relations)}, result AS ({body}) SELECT {shown(columns)} FROM result"


def result_sql(result: str) -> str:
    relations, body = RESULTS[result]
    return query(relations, body, COLUMNS[result])


# Pages of the result sets: order and size.
PAGES = {
    "V01": ("conflict_heatmap", '"date" DESC NULLS LAST, "country" ASC NULLS FIRST', 200),
    "V02": ("top_news_countries", '"date" DESC NULLS LAST, "rank" ASC NULLS FIRST, "country" ASC NULLS FIRST', 100),
    "V03": ("tone_source_correlation", '"date" DESC NULLS LAST, "country" ASC NULLS FIRST', 100),
    "V04": ("cameo_distribution", '"date" DESC NULLS LAST, "event_count" DESC NULLS LAST, "EventRootCode" ASC NULLS FIRST, "region" ASC NULLS FIRST', 200),
    "V05": ("actor_interaction_matrix", '"event_count" DESC NULLS LAST, "actor1_type" ASC NULLS FIRST, "actor2_type" ASC NULLS FIRST', 100),
    "V06": ("media_coverage_ratio", '"mentions_per_event" DESC NULLS LAST, "country" ASC NULLS FIRST, "date" ASC NULLS FIRST', 50),
    "V07": ("sentiment_trend", '"country" ASC NULLS FIRST, "date" ASC NULLS FIRST', 2000),
    "V08": ("conflict_pairs", '"conflict_count" DESC NULLS LAST, "actor1_country" ASC NULLS FIRST, "actor2_country" ASC NULLS FIRST, "date" ASC NULLS FIRST', 50),
    "V09": ("escalation_events", '"escalation_ratio" DESC NULLS LAST, "GlobalEventID" ASC NULLS FIRST, "mention_hour" ASC NULLS FIRST', 30),
    "V10": ("religion_conflict_cluster", '"event_count" DESC NULLS LAST, "religion" ASC NULLS FIRST, "region" ASC NULLS FIRST, "date" ASC NULLS FIRST', 50),
    "V11": ("gkg_themes_continent", '"year" DESC NULLS LAST, "continent" ASC NULLS FIRST, "rank" ASC NULLS FIRST, "theme" ASC NULLS FIRST', 200),
    "V12": ("top_organizations", '"date" DESC NULLS LAST, "rank" ASC NULLS FIRST, "organization" ASC NULLS FIRST', 100),
    "V13": ("tone_conflict_lag", '"date" DESC NULLS LAST, "country" ASC NULLS FIRST', 200),
    "V14": ("diplomatic_network", '"total_interactions" DESC NULLS LAST, "source_country" ASC NULLS FIRST, "target_country" ASC NULLS FIRST', 50),
    "V15": ("source_diversity_index", '"source_diversity_index" DESC NULLS LAST, "country" ASC NULLS FIRST, "date" ASC NULLS FIRST', 50),
    "V16": ("ethnic_conflicts", '"event_count" DESC NULLS LAST, "ethnicity" ASC NULLS FIRST, "date" ASC NULLS FIRST', 30),
    "V17": ("breaking_news", '"first_mention_time" DESC NULLS LAST, "GlobalEventID" ASC NULLS FIRST', 30),
    "V18": ("extreme_tone_events", '"AvgTone" ASC NULLS FIRST, "GlobalEventID" ASC NULLS FIRST, "tone_extreme_type" ASC NULLS FIRST', 30),
    "V19": ("top_article_coverage", '"total_articles" DESC NULLS LAST, "country" ASC NULLS FIRST', 50),
}


# Views whose panel is more than the first rows of the page: select list, filter or source, and row limit.
_PANELS = {
    "V01": ("*, CASE WHEN avg_goldstein < -3 THEN 'severe' WHEN avg_goldstein > 3 THEN 'cooperative' "
            "ELSE 'neutral' END AS severity", "page", 20, " severity"),
    "V02": ("*", "(SELECT * FROM page WHERE rank = 1)", 14, ""),
    "V03": ("*, coalesce(tone_sources_correlation > 0.5, false) AS strong", "page", 15, " strong"),
    "V10": ("*, CASE WHEN avg_goldstein < 0 THEN 'hostile' ELSE 'favourable' END AS sign", "page", 15, " sign"),
    "V16": ("* REPLACE (coalesce(ethnicity, 'N/A') AS ethnicity)", "page", 10, ""),
    "V17": ("* REPLACE (coalesce(country, 'N/A') AS country)", "page", 10, ""),
}
_FIRST = {"V05": 20, "V06": 15, "V08": 15, "V09": 10, "V11": 20, "V12": 15, "V13": 12, "V14": 12, "V15": 12,
          "V18": 20, "V19": 15}


def _page(key: str) -> tuple[tuple[str, ...], str]:
    result, order, limit = PAGES[key]
    relations, body = RESULTS[result]
    return (*relations, f"page AS (SELECT * FROM ({body}) ORDER BY {order} LIMIT {limit})"), COLUMNS[result]


def page_sql(key: str) -> str:
    relations, columns = _page(key)
    return query(relations, "SELECT * FROM page", columns)


def panel_sql(key: str) -> str:
    relations, columns = _page(key)
    order = PAGES[key][1]
    if key == "V04":
        body = """SELECT coalesce(region, 'Other') AS region, CAST(sum(event_count) AS BIGINT) AS event_count
                  FROM page GROUP BY 1 ORDER BY event_count DESC, region LIMIT 8"""
        return query(relations, body, "region event_count")
    if key == "V07":
        body = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY date DESC) AS age
                    FROM page WHERE country IN (SELECT DISTINCT country FROM page ORDER BY country LIMIT 3))
                  WHERE age <= 30"""
        return query(relations, body, columns)
    if key in _FIRST:
        body = f"SELECT * FROM page ORDER BY {order} LIMIT {_FIRST[key]}"
        return query(relations, body, columns)
    select, source, limit, extra = _PANELS[key]
    body = f"SELECT {select} FROM {source} ORDER BY {order} LIMIT {limit}"
    return query(relations, body, columns + extra)
