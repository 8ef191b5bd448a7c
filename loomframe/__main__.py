"""python -m loomframe."""

from loomframe.cli import main

raise SystemExit(main())
