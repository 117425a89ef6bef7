"""python -m barscreen"""

import sys

from barscreen.cli import main

sys.exit(main())
