"""python -m skein EXPORTS [--level LEVEL ...] [--id ID] [--list] [--out FOLDER]: compresses exports, or lists what is in them."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from skein.functions import fixed
from skein.plans.compress import compress_levels, write
from skein.sources import exports


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="skein", description=__doc__)
    p.add_argument("exports", help="a file, folder or pattern")
    p.add_argument("--level", action="append", choices=tuple(fixed.BUDGET_CHARS), help="may be given more than once; resume by default")
    p.add_argument("--id", help="one conversation; all by default")
    p.add_argument("--type", help="the conversations' type, instead of the one found")
    p.add_argument("--list", action="store_true", help="show the newest 50 conversations")
    p.add_argument("--out", help="folder for the documents; standard output by default")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("skein").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    files = exports.read(spark, a.exports)
    bad = False
    for r in exports.identify(files).filter("error IS NOT NULL").select("file", "error").toLocalIterator():
        print(f"{r.file}: {exports.ERRORS[r.error]}")
        bad = True
    if a.list:
        for r in exports.list_conversations(files).limit(50).collect():
            print(f"{r.id}\t{r.created_at}\t{r.message_count}\t{r.title}")
        return 0
    corpus = exports.parse(files)
    documents = compress_levels(exports.pick(corpus, a.id) if a.id else corpus, a.level or ["resume"], a.type)
    if a.out:
        write(documents, a.out)
    else:
        for r in documents.toLocalIterator():
            print(r.markdown)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
