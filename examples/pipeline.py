"""A whole run: sources registered, a graph executed into a store, the store verified and reported.

python examples/pipeline.py SF_DIR OUT_DIR
"""

import sys
import uuid
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from fedlens.common import local_session, table
from fedlens.plans import report
from fedlens.plans.graph import Graph, Node
from fedlens.plans.session import Session
from fedlens.sources.store import Bundle


def main(sf_dir: str, out_dir: str) -> str:
    spark = local_session()
    session = Session(spark, Bundle.create(spark, f"file://{Path(out_dir).resolve()}", uuid.uuid4().hex), snapshot_every=10)
    for name in ("orders", "customer"):
        session.register(f"dataset://raw/{name}", table(spark, sf_dir, name), f"file://{sf_dir}/{name}.parquet", trust="trusted")
    nodes = (
        Node("1/large", "filter_rows", inputs=("dataset://raw/orders",), outputs=("dataset://large",), params={"predicate": "o_totalprice > 100000"}),
        Node("2/keyed", "map", inputs=("dataset://raw/customer",), outputs=("dataset://keyed",), params={"select": ["c_custkey AS o_custkey", "c_mktsegment"]}),
        Node("3/joined", "join", inputs=("dataset://large", "dataset://keyed"), outputs=("dataset://joined",), params={"on": "o_custkey"}),
        Node("4/sums", "aggregate", inputs=("dataset://joined",), outputs=("dataset://sums",), params={"by": ["c_mktsegment"], "aggregates": {"orders": "count(*)", "total": "round(sum(o_totalprice), 2)"}}),
    )
    done = session.run(Graph(nodes), out_dir=f"{session.bundle.root}/data")
    session.finalize()
    session.frames["dataset://sums"].show()
    page = f"{out_dir}/report.html"
    Path(page).write_text(report.html(report.load(spark, session.bundle.root)))
    print(f"ran {done.succeeded}; report in {page}")
    return page


if __name__ == "__main__":
    main(*sys.argv[1:3])
