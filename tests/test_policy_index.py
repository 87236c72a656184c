from pyspark.sql import functions as F

from creditloom.operators import term_index
from creditloom.plans import policy_index
from creditloom.sources.snapshots import read_parts, replace_part

WORDS = "loan rate income score limit debt fraud desk branch review audit cap floor ratio".split()


def write(folder, name, seed, n=40):
    text = "\n\n".join(
        f"SECTION {i}: part {i}\n" + " ".join(WORDS[(seed * i + j * j) % 14] + f"{j % 3}" for j in range(20))
        for i in range(1, n)
    )
    (folder / f"{name}.txt").write_text(text)


def hits(spark, index):
    asked = spark.createDataFrame(
        [("a", "debt0 ratio1 cap2"), ("b", "fraud0 desk1"), ("c", "nothing of this")],
        "query_id string, question string",
    )
    rows = policy_index.retrieve(spark, index, asked, k=4).collect()
    return sorted((r.query_id, r["rank"], r.id, r.filename, r.chunk_index, r.distance) for r in rows)


def test_a_new_file_counts_only_its_own_chunks(spark, tmp_path, monkeypatch):
    docs = tmp_path / "docs"
    docs.mkdir()
    write(docs, "one", 3)
    write(docs, "two", 5)
    index, rebuilt = str(tmp_path / "index"), str(tmp_path / "rebuilt")
    policy_index.build_index(spark, str(docs), index)
    (docs / "three.txt").write_text((docs / "two.txt").read_text().replace("debt", "credit"))
    # the id has the beginning of a chunk, so this one keeps its id
    (docs / "one.txt").write_text((docs / "one.txt").read_text().replace("\n\nSECTION 7:", " theft0\n\nSECTION 7:"))
    counted = []
    plain = term_index.counted

    def watched(df, *args):
        counted.append(df.count())
        return plain(df, *args)

    monkeypatch.setattr(term_index, "counted", watched)
    n = policy_index.build_index(spark, str(docs), index)
    monkeypatch.undo()
    changed = read_parts(spark, f"{index}/chunks").where("text like '%theft0%' or metadata.source = 'three'")
    assert counted == [changed.count()] and counted[0] < n
    assert policy_index.build_index(spark, str(docs), rebuilt) == n
    assert hits(spark, index) == hits(spark, rebuilt)
    # nothing new: nothing is written
    before = read_parts(spark, f"{index}/chunks").inputFiles()
    assert policy_index.build_index(spark, str(docs), index) == n
    assert read_parts(spark, f"{index}/chunks").inputFiles() == before


def test_frequencies_of_another_version_are_not_used(spark, tmp_path):
    docs, index = tmp_path / "docs", str(tmp_path / "index")
    docs.mkdir()
    write(docs, "one", 3)
    policy_index.build_index(spark, str(docs), index)
    want = hits(spark, index)
    stale = read_parts(spark, f"{index}/frequencies").withColumns(
        {"n": F.col("n") + 100, "version": F.lit("of a writer that died")}
    )
    replace_part(stale, f"{index}/frequencies")
    assert hits(spark, index) == want
