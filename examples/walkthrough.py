"""A walk through the engine: a log, a stream, a baseline and an anomaly query, then the same over HTTP.

Run from the repository: python examples/walkthrough.py
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import urllib.request

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quadtide import sparql  # noqa: E402
from quadtide.api import Engine  # noqa: E402
from quadtide.server import serve  # noqa: E402
from quadtide.session import session  # noqa: E402
from quadtide.sources.log import QuadLog  # noqa: E402
from quadtide.streaming.live import StreamInput  # noqa: E402

QUERY = """PREFIX e: <http://example.org/>
PREFIX fn: <https://quadtide.example/fn#>
PREFIX base: <https://quadtide.example/baseline#>
REGISTER RStream e:alerts AS
SELECT ?sensor ?v ?now
FROM NAMED WINDOW e:past ON LOG e:store [START 0 END 10000]
FROM NAMED WINDOW e:live ON STREAM e:sensors [RANGE 1000 STEP 500]
USING BASELINE e:past AGGREGATE
WHERE {
  WINDOW e:past { ?sensor e:temperature ?v }
  WINDOW e:live { ?sensor e:temperature ?now }
  ?sensor base:v ?usual .
  FILTER(fn:relative_threshold_exceeded(?now, ?usual, 0.5))
}"""


def main() -> None:
    spark = session("walkthrough", spark__master="local[2]", spark__ui__enabled="false", spark__sql__shuffle__partitions="2")
    spark.sparkContext.setLogLevel("ERROR")
    e = "http://example.org/"
    log = QuadLog(spark, tempfile.mkdtemp() + "/log")
    log.write_all((100 * k, f"{e}sensor{k % 3}", f"{e}temperature", str(20 + k % 4), f"{e}sensors") for k in range(90))
    log.flush()
    print("means by SPARQL:")
    sparql.query(log.quads(), f"SELECT ?s (AVG(?v) AS ?mean) {{ GRAPH <{e}sensors> {{ ?s <{e}temperature> ?v }} }} GROUP BY ?s").show(truncate=False)
    stream = StreamInput(spark, f"{e}sensors")
    stream.add_all([(100, f"{e}sensor0", f"{e}temperature", "21", ""), (200, f"{e}sensor1", f"{e}temperature", "44", "")])
    stream.close(5000)
    engine = Engine(spark, log, {f"{e}sensors": stream.read})
    engine.register_query("alerts", QUERY)
    for result in engine.start_query("alerts"):
        if result.source == "Live":
            print("alert:", result.timestamp, result.bindings)
    server = serve(engine, port=0)
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_address[1]}/api/queries/alerts") as r:
        print("over HTTP:", json.loads(r.read())["status"])
    server.shutdown()
    spark.stop()


if __name__ == "__main__":
    main()
