"""python -m pagemill"""

import sys

from .cli import main

sys.exit(main())
