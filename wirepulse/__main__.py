import sys

from wirepulse.cli import main

sys.exit(main())
