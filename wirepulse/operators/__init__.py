"""The analyses and serving views, each a plain ``DataFrame -> DataFrame`` function."""
