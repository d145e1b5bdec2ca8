import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from cropline.functions import constants as K
from cropline.operators import clean as C
from cropline.plans.prediction import predict, published
from cropline.sources.files import read_log
from cropline.sources.requests import parse_requests, read_requests, response_json
from cropline.streaming.prediction import predict_stream
from tests.test_scoring import world  # noqa: F401

AS_OF = date(2024, 6, 15)
PLACE = {"state": "kerala", "district": "d1", "crop": "Rice", "season": "Autumn"}
BODIES = [
    {"req_id": 1, **PLACE},
    {"req_id": 2, **PLACE, "rainfall": None},
    {"req_id": 3, **PLACE, "min_price": None, "area": "2.5", "rainfall": 100},
    {"req_id": 4, **PLACE, "area": None},
    {"req_id": 5, **PLACE, "year": "soon"},
    {"req_id": 6, **PLACE, "max_price": "dear"},
]


@pytest.fixture
def request_file(tmp_path):
    path = tmp_path / "in" / "requests.json"
    path.parent.mkdir()
    path.write_text("\n".join(json.dumps(b) for b in BODIES) + "\n")
    return str(path.parent)


def test_absent_and_null_differ(spark, request_file):
    df = C.validate_requests(C.normalise_requests(read_requests(spark, request_file), AS_OF))
    rows = {r.req_id: (r.reason, r.area) for r in df.collect()}
    assert rows == {
        1: (None, 1.0), 2: (K.BAD_RAINFALL, 1.0), 3: (None, 2.5), 4: (K.BAD_AREA, None), 5: (K.BAD_DATE, 1.0), 6: (K.BAD_PRICE, 1.0)
    }


def test_responses_are_nested_json(spark, request_file, world):  # noqa: F811
    requests = read_requests(spark, request_file).withColumn("given_price", F.lit(100.0))
    rows = response_json(published(predict(requests, world[2], AS_OF))).collect()
    body = {r.req_id: json.loads(r.response) for r in rows}
    assert set(body) == {1, 3}
    assert body[3]["inputs_used"]["rainfall"] == 100.0 and body[3]["status"] == "success"
    assert {"year", "yield", "price"} == set(body[3]["historical_trend"][0])


def test_request_stream_is_logged_once(spark, request_file, world, tmp_path):  # noqa: F811
    out, state = str(tmp_path / "log"), str(tmp_path / "state")
    for _ in range(2):
        lines = spark.readStream.text(request_file)
        requests = parse_requests(lines).withColumn("given_price", F.lit(100.0))
        predict_stream(requests, world[2], AS_OF, out, state).awaitTermination()
    assert sorted(r.id for r in read_log(spark, out).collect()) == [1, 3]


def test_whole_number_fields(spark):
    bodies = [{"year": 2024.0}, {"year": 2024.9}, {"year": 2024}, {"year": "2024"}, {"year": "2024.0"}, {"month": 6.0}, {}]
    lines = spark.createDataFrame([(i, json.dumps({**PLACE, **b})) for i, b in enumerate(bodies)], "i long, value string")
    df = C.validate_requests(C.normalise_requests(parse_requests(lines, req_id=F.col("i")), AS_OF))
    rows = {r.req_id: (r.year, r.month, r.reason) for r in df.collect()}
    assert all(rows[i] == (2024, 6, None) for i in (0, 1, 2, 3, 5, 6)) and rows[4][2] == K.BAD_DATE
