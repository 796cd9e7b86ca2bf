"""Command line: build an index, rank pages, search.

python -m siftwell index PAGES OUT     PAGES: Parquet of (doc_id, text); OUT: postings
python -m siftwell lines PAGES OUT     the same as posting lines
python -m siftwell rank GRAPH OUT      GRAPH: adjacency text; OUT: Parquet of (id, rank)
python -m siftwell search INDEX RANKS QUERY [START]     RANKS: Parquet of (fingerprint, rank, urls)
"""

from __future__ import annotations

import sys

from .operators import index, rank, search
from .session import get_session
from .sources import readers, writers


def main(args: list[str]) -> int:
    if len(args) < 3 or args[0] not in ("index", "lines", "rank", "search"):
        print(__doc__)
        return 2
    spark = get_session()
    if args[0] in ("index", "lines"):
        docs = spark.read.parquet(args[1])
        rows = index.postings(index.document_frequency_rows(docs), docs.count(), "reference" if args[0] == "lines" else "intended")
        if args[0] == "index":
            writers.write_index(rows, args[2])
        else:
            writers.write_posting_lines(index.posting_lines(rows), args[2])
    elif args[0] == "rank":
        writers.write_ranks(rank.pagerank(rank.edges_of(readers.adjacency_files(spark, args[1]))), args[2])
    else:
        start = int(args[4]) if len(args) > 4 else 0
        search.search(spark, args[3], spark.read.parquet(args[1]), spark.read.parquet(args[2]), start).show(search.PAGE, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
