"""python -m loomstone compress SOURCE ARCHIVE | extract ARCHIVE FOLDER | list ARCHIVE | verify ARCHIVE"""

from __future__ import annotations

import argparse
import getpass
import sys


def main(args: list[str]) -> int:
    p = argparse.ArgumentParser(prog="loomstone")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compress")
    c.add_argument("source")
    c.add_argument("archive")
    c.add_argument("--level", help="spark.loomstone.level, or balanced, if not given")
    c.add_argument("--volume-size", type=int, default=0)
    c.add_argument("--force", action="store_true", help="replace an archive that exists")
    c.add_argument("--verify", action="store_true")
    c.add_argument("--timings", action="store_true", help="tell where the time went")
    e = sub.add_parser("extract")
    e.add_argument("archive")
    e.add_argument("folder")
    for name in ("list", "verify"):
        sub.add_parser(name).add_argument("archive")
    for s in sub.choices.values():
        s.add_argument("--password", action="store_true", help="ask for a password")
        s.add_argument("--shared", help="folder that driver and executors share, if spark.checkpoint.dir is not set")
    a = p.parse_args(args)
    from pyspark.sql import SparkSession

    from loomstone.api import Archive
    from loomstone.sources.archive import existing

    builder = SparkSession.builder.appName("loomstone")
    if a.shared:
        builder = builder.config("spark.checkpoint.dir", a.shared)
    spark = builder.getOrCreate()
    password = getpass.getpass() if a.password else None
    if a.command == "compress":
        if a.force:
            for name in existing(spark, a.archive):
                print(f"replacing {a.archive.rstrip('/')}/{name}")
        job = Archive.write(spark, a.source).output(a.archive).volume_size(a.volume_size).password(password).overwrite(a.force).verify(a.verify)
        row = (job.level(a.level) if a.level else job).run().first()
        print(f"{row.n_files} files, {row.original_size} bytes, stored in {row.compressed_size}, {row.ratio_x or 0:.3f} times smaller")
        if a.timings:
            for r in job.timings().collect():
                print(f"{r.phase}: {r.seconds:.2f} s, {r.share:.0%}")
    elif a.command == "extract":
        for r in Archive.read(spark, a.archive).password(password).output(a.folder).run().groupBy("status").count().collect():
            print(r["status"], r["count"])
    elif a.command == "list":
        for r in Archive.read(spark, a.archive).password(password).list_files().orderBy("path").toLocalIterator():
            print(r.path)
    else:
        for r in Archive.read(spark, a.archive).password(password).verify().collect():
            print(r.status, r.n)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
