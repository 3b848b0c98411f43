"""``python -m quernis FILE``: prints a CSV file as a table."""

import sys

from quernis.session import local_session
from quernis.sources.files import read_csv


def main(args: list[str]) -> int:
    if len(args) != 1:
        print("usage: python -m quernis FILE.csv", file=sys.stderr)
        return 2
    print(read_csv(local_session(2), args[0]))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
