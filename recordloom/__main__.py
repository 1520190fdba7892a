import sys

from .plans.verbs import main

sys.exit(main(sys.argv[1:]))
