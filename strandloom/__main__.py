import sys

from strandloom.plans.run import main

main(sys.argv[1:])
