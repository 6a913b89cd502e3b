import sys

from .service import main

sys.exit(main())
