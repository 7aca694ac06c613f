"""The names of archives go to the driver, not into a table, and small archives share tasks."""

from pathlib import Path

from test_contracts import pages

from relplan.llm import wacz
from relplan.sources import shared


def test_small_archives_share_tasks_and_their_names_need_no_table(spark):
    rows = [(i, f"http://x/{i}", f"<p>{i % 150}</p>" * 20) for i in range(200)]
    root = Path(shared.shared_dir(spark).removeprefix("file://"))
    before = set(root.iterdir()) if root.exists() else set()
    target = shared.new_path(spark, "wacz")
    manifest = wacz.write(pages(spark, rows), target, most_bytes=1000)
    names = sorted(r.path for r in manifest.collect())
    assert len(names) > 20 and names == sorted(r.path for r in manifest.collect()) and all(Path(n).exists() for n in names)
    assert [p.name for p in set(root.iterdir()) - before] == [target.rsplit("/", 1)[1]]
    found = wacz.read(spark, manifest, target)
    assert found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert sorted(r.page_id for r in found.select("page_id").collect()) == list(range(200))
    assert found.where("record_type = 'revisit'").count() == 50
