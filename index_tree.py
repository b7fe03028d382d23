"""Indexes a tree of source files: python index_tree.py ROOT [options of the index command]."""

import sys

from symlake.cli import main

if __name__ == "__main__":
    sys.exit(main(["index", *sys.argv[1:]]))
