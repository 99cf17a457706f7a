"""Lines that repeat their number: of those that the order leaves open the first one written counts, in any layout of files."""

import duckdb
import pytest

from quire import catalog


@pytest.fixture(scope="module")
def tied(spark, sf, tmp_path_factory):
    """A folder whose lineitem is a short file and then a longer one that repeats its lines in other places, of other sizes."""
    where = tmp_path_factory.mktemp("tied")
    lines = f"select * from '{sf}/lineitem.parquet' where l_orderkey % 3 = 0"
    other = "select * exclude (i) replace ((l_suppkey + 7) % 1000 as l_suppkey, l_quantity + 1 + i as l_quantity)"
    (where / "lineitem.parquet").mkdir()
    c = duckdb.connect()
    c.execute(f"copy ({lines} order by l_orderkey, l_linenumber, l_partkey, l_suppkey) to '{where}/lineitem.parquet/part-0.parquet'")
    c.execute(f"copy ({other} from ({lines}), range(20) t(i)) to '{where}/lineitem.parquet/part-1.parquet'")
    c.execute("set threads = 1")
    c.execute(f"create view lineitem as select * from '{where}/lineitem.parquet/*.parquet'")
    return str(where), c


@pytest.mark.parametrize("name", ["touching_groups", "mosaics", "text_blocks", "box_places", "page_frames"])
def test_first_written_counts(spark, tied, name):
    where, duck = tied
    df = catalog.QUERIES[name](spark, where)
    result = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    want = sorted(tuple(r[names.index(c)] for c in df.columns) for r in result.fetchall())
    assert sorted(map(tuple, df.collect())) == want and want
