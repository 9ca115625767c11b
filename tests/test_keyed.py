import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from geoshroud.functions import keyed


def test_hmac_matches_library(spark):
    key = bytes(range(32))
    got = spark.range(20).select("id", keyed.hmac_hex(key, keyed.u64(F.col("id"))).alias("h")).collect()
    assert all(r["h"] == hmac.new(key, r["id"].to_bytes(8, "big"), hashlib.sha256).hexdigest() for r in got)


def test_coordinates_stay_in_box_and_depend_on_key(spark):
    box = (1.0, 2.0, 3.0, 5.0)
    a, b = ([tuple(r["c"]) for r in spark.range(50).select(keyed.prf_coordinates(k * 32, F.col("id"), box).alias("c")).collect()] for k in (b"a", b"b"))
    assert a != b and all(1 <= x <= 3 and 2 <= y <= 5 for x, y in a)


def test_key_files_and_checksums(tmp_path):
    key = keyed.generate_key()
    keyed.save_key(key, tmp_path / "k")
    assert keyed.load_key(tmp_path / "k") == key
    (tmp_path / "short").write_bytes(b"x")
    with pytest.raises(ValueError):
        keyed.load_key(tmp_path / "short")
    c = keyed.checksum(key, "g", "a")
    assert keyed.verify_checksum(key, "g", "a", c) and not keyed.verify_checksum(key, "g", "b", c)
