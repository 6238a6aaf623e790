import sys

from millrace.cli import main

sys.exit(main())
