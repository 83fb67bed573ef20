import pytest
from proofmill.operators import lineage

WAY = [(1, 2, "compiled_from"), (2, 3, "confirmed_by"), (3, 4, "supported_by"), (4, 5, "ingested_in"), (5, 6, "snapshot_of"), (6, 7, "granted_by")]
SECOND = [(3, 14, "supported_by"), (14, 15, "ingested_in"), (15, 16, "snapshot_of"), (16, 17, "granted_by")]


@pytest.mark.parametrize("edges, active, want", [
    (WAY, True, (True, None, 1)), (WAY, False, (False, "inactive", 1)), (WAY + SECOND, False, (True, None, 2)),
    *[([e for e in WAY if e != gone], True, (False, gone[2], int(k == 5))) for k, gone in enumerate(WAY)],
    ([(1, 2, "compiled_from"), (2, 9, "decided_by")], True, (True, None, 0)),
    ([*WAY[:2], (3, 4, "ingested_in"), *WAY[3:]], True, (False, "supported_by", 0)),  # the wrong kind of edge leads nowhere
    ([*WAY[:4], (1, 6, "granted_by"), (5, 4, "ingested_in")], True, (False, "snapshot_of", 0)),
])
def test_chains(spark, edges, active, want):
    grants = spark.createDataFrame([(7, active), (17, True)], "node long, active boolean")
    got = lineage.chains(spark.createDataFrame([(1,)], "node long"), spark.createDataFrame(edges, "src long, dst long, edge_type string"), grants).first()
    assert (got.complete, got.gap, got.n_snapshots) == want
