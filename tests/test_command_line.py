import pytest

import bench
import run
from creditloom.sources.snapshots import read_table


def test_commands(spark, sf, tmp_path, capsys):
    raw, lake = bench.write_raw_files(spark, sf), str(tmp_path / "lake")
    common = ["--raw", raw, "--lake", lake, "--as-of", "2001-08-01"]
    run.main(["pipeline", *common, "--date", "2024-01-01", "--version", "v1"])
    run.main(["pipeline", *common, "--date", "2024-01-02", "--version", "v2"])
    run.main(["promote", "--lake", lake, "--version", "v2"])
    models = read_table(spark, f"{lake}/model_registry")
    states = {r.model_version: r.status for r in models.collect()}
    assert states == {"v1": "retired", "v2": "active"}
    ids = tmp_path / "ids.csv"
    ids.write_text("application_id\napp000000000000\nnobody\n")
    run.main(["score", "--lake", lake, "--ids", str(ids), "--out", str(tmp_path / "out")])
    rows = spark.read.option("header", True).csv(str(tmp_path / "out")).collect()
    assert {(r.application_id, r.error) for r in rows} == {
        ("APP000000000000", None), ("NOBODY", "NOBODY not found"),
    }
    assert "v1 active" in capsys.readouterr().out

    someone = read_table(spark, f"{lake}/pd_predictions").first()
    for report in ("grades", "kpis", "trend", "agreement", "decisions", "monitoring", "models"):
        run.main(["show", report, "--lake", lake])
    run.main(["show", "customer", someone.customer_id, "--lake", lake])
    run.main(["show", "drivers", someone.application_id, "v2", "3", "--lake", lake])
    printed = capsys.readouterr().out
    assert someone.application_id in printed and "increases_risk" in printed
    with pytest.raises(LookupError, match="is not known"):
        run.main(["show", "customer", "nobody", "--lake", lake])
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "policy.txt").write_text("SECTION 1: Limits\n\nLoans above the income limit are declined by policy.\n")
    run.main(["index", "--lake", lake, "--docs", str(docs)])
    run.main(["ask", "What is the income limit?", "--lake", lake, "--application", someone.application_id])
    prompt = capsys.readouterr().out
    assert "income limit are declined" in prompt and someone.application_id in prompt
    assert "Top risk drivers" in prompt
