"""Ranges and chunks of files are dealt to tasks by the size of the files."""

from pyspark.sql import functions as F

from strandframe.sources import binary, blocks, read_index


def test_chunks_are_read_by_many_tasks(spark, tmp_path):
    rows = [(f"r{k}", 0, "c", k * 40, 60, [(50, "M")], "*", -1, 0, "ACGTA" * 10, "?" * 50, None) for k in range(4000)]
    reads = spark.createDataFrame(rows, "qname string, flag int, rname string, pos int, mapq int, cigar array<struct<len:int,op:string>>, rnext string, pnext int, tlen int, seq string, qual string, tags map<string,struct<type:string,value:string>>")
    folder = f"file://{tmp_path}/reads"
    binary.write(reads.repartition(6), folder, [("c", 200_000)])
    index = read_index.index_reads(spark, folder, folder + "-index", 3000)
    got = read_index.read_chunks(index.where("kind = 'chunk'"))
    assert got.select("qname").distinct().count() == got.count() == 4000
    assert got.select(F.spark_partition_id()).distinct().count() > 1


def test_ranges_grow_with_files(spark, tmp_path):
    for name, n in (("a", 1000), ("b", 40 << 20)):
        (tmp_path / f"{name}.bam").write_bytes(b"x")
        with open(tmp_path / f"{name}.bam", "wb") as f:
            f.truncate(n)
    cores = spark.sparkContext.defaultParallelism
    size = lambda p, **k: blocks.split_size(spark, str(p), ".bam", **k)
    assert size(tmp_path / "a.bam") == 128 << 10
    assert size(tmp_path / "b.bam") == (40 << 20) // (4 * cores) and size(tmp_path, most=1 << 20) == 1 << 20


def test_offsets_over_files(spark, tmp_path):
    from strandframe.plans import queries as q
    from strandframe.plans import record_queries  # noqa: F401

    texts = {k: "acgt" * (k * 7 % 40) + "ac"[: k % 3] for k in range(1, 60)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    want, at = set(), 0
    for k, t in texts.items():
        if t:
            at += len(f">s{k}\n")
            want.add(f"s{k} {len(t)} {at} {min(len(t), 60)} {min(len(t), 60) + 1}")
            at += len(t) + -(-len(t) // 60)
    assert {r["place"] for r in q.QUERIES["fasta_index"](spark, str(tmp_path)).collect()} == want
