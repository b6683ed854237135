import sys

from cohortloom.cli import main

sys.exit(main())
