"""python -m lamina info ROOT: what an engine's folder holds."""

from __future__ import annotations

import sys

from lamina.operators.engine import Engine
from lamina.session import session


def main(args: list[str]) -> int:
    if len(args) != 2 or args[0] != "info":
        print(__doc__)
        return 2
    engine = Engine(session(), args[1])
    print(f"transactions: {len(engine.finished)}, snapshot: {engine.snapshot()}")
    for name in engine.tables():
        t = engine.table(name)
        m = t.manifest
        print(f"{name}: version {m['version']}, {len(m['files'])} files, {t.manifest_count()} row versions, horizon {m['horizon']}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
