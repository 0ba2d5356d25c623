import sys

from pipequery.cli import main

sys.exit(main())
