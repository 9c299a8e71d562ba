import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from ballot.session import build_session

    s = build_session(cpus=4, partitions=4, app="ballot-tests")
    yield s
    s.stop()


def preds_df(spark, rows, with_rank=False):
    """Micro predictions: (model, user, book, raw_score[, rnk])."""
    if with_rank:
        schema = "model string, user_id long, book_id long, raw_score double, rnk int"
    else:
        schema = "model string, user_id long, book_id long, raw_score double"
    return spark.createDataFrame(rows, schema)


def rows(df, *cols):
    cols = cols or tuple(df.columns)
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
