"""python -m docloom ROOT ingest PATH | faq PATH | index | search TEXT | answer CSV"""

from __future__ import annotations

import sys

from docloom.api import Engine
from docloom.session import get_session


def main(args: list[str]) -> int:
    if len(args) < 2 or args[1] not in ("ingest", "faq", "index", "search", "answer") or args[1] != "index" and len(args) < 3:
        print(__doc__)
        return 2
    engine = Engine(get_session(), args[0])
    if args[1] == "ingest":
        print(engine.ingest_manuals(args[2]).count(), "chunks")
    elif args[1] == "faq":
        print(engine.ingest_faq(args[2]).count(), "entries")
    elif args[1] == "index":
        engine.build_index()
    elif args[1] == "search":
        q = engine.spark.createDataFrame([("q", args[2])], "task_id string, query string")
        engine.search(q).orderBy("score", ascending=False).show(10, 80)
    else:
        engine.answer_batch(args[2]).show(50, 80)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
