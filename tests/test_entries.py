"""Finding and listing where tables are folders of files."""

from weftline.functions import tables
from weftline.plans.catalogue_suite import QUERIES


def names(df):
    return sorted(r.name for r in df.collect())


def folder(tmp_path):
    for x in ("region.parquet/part-0.parquet", "region.parquet/part-1.parquet", "pages.parquet/deep/part-0.parquet", "nation.parquet", ".hidden.parquet", "empty.parquet/", "other.txt"):
        p = tmp_path / x
        p.parent.mkdir(parents=True, exist_ok=True)
        p.mkdir() if x.endswith("/") else p.write_text("x")
    return str(tmp_path)


def test_find_files(spark, tmp_path):
    base = folder(tmp_path)
    assert names(QUERIES["F31_findfiles"](spark, base)) == ["empty.parquet", "nation.parquet", "pages.parquet", "region.parquet"]
    assert names(tables.find_files(spark, base + "/.*.parquet")) == [".hidden.parquet"]
    assert names(tables.find_files(spark, base + "/**/part-0.parquet")) == ["part-0.parquet", "part-0.parquet"]
    assert names(tables.find_files(spark, base + "/none*")) == []


def test_list_files(spark, tmp_path):
    base = folder(tmp_path)
    assert names(QUERIES["F71_lsdir"](spark, base)) == ["nation.parquet", "pages.parquet", "region.parquet"]
    assert names(tables.list_files(spark, base, r".*\.txt")) == ["other.txt"]
    assert names(tables.list_files(spark, base + "/none", ".*")) == []
