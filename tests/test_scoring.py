import hashlib
import json

import pytest

from gradus.functions import scoring


def pairs(spark, n):
    return spark.createDataFrame([(str(i), "c" * (i % 5), "r" * (1 + i % 7)) for i in range(n)], "example_id string, context string, response string").repartition(3)


def short_of_memory(most, kind=RuntimeError):
    def load():
        seen = {"calls": 0}

        def model(some):
            seen["calls"] += 1
            if len(some) > (most if seen["calls"] < 40 else 10**6):
                raise kind("CUDA Out of Memory")
            model.last_batch_metadata = [{"input_length": len(c) + len(r), "truncated": False} for c, r in some]
            return [1 / len(r) for _, r in some]

        return model

    return load


@pytest.mark.parametrize("kind", [RuntimeError, MemoryError])
def test_batches_give_way_and_grow_again(spark, kind):
    got = scoring.score(pairs(spark, 1500), short_of_memory(8, kind), batch=32).collect()
    assert {r.example_id: r.support for r in got} == {str(i): 1 / (1 + i % 7) for i in range(1500)} and len(got) == 1500
    sizes = {r.call: (r.call_size, r.halved) for r in got}
    assert max(n for n, _ in sizes.values()) == 32 and min(n for n, _ in sizes.values()) <= 8 and any(h == 2 for _, h in sizes.values())
    assert all(r.input_length == int(r.example_id) % 5 + 1 + int(r.example_id) % 7 and r.truncated is False and r.milliseconds >= 0 for r in got)


def test_errors_stop_the_query(spark):
    for load, what in (
        (lambda: lambda some: [0.5], "another number of scores"), (lambda: lambda some: ["x"] * len(some), "has to be a number"), (short_of_memory(0), "single pair"), (lambda: lambda some: 1 / 0, "ZeroDivision"),
    ):
        with pytest.raises(Exception, match=what):
            scoring.score(pairs(spark, 20), load).collect()
    assert scoring.score(pairs(spark, 20).limit(0), short_of_memory(0)).count() == 0


APPROVED = {"repository": "r", "revision": "v1", "security_status": "approved", "custom_code_hashes": {"a.py": "1", "b.py": "2"}, "weight_file": {"name": "w", "etag": "e"}}


def test_gate(spark, tmp_path):
    path = tmp_path / "manifest.json"
    put = lambda value: path.write_text(value if isinstance(value, str) else json.dumps(value))
    put(json.dumps(APPROVED | {"more": 1}, indent=2))
    assert scoring.gate(spark, str(path), APPROVED, revision="v1")["more"] == 1
    changed = [("repository", "x"), ("revision", "v2"), ("security_status", "pending"), ("custom_code_hashes", {"a.py": "1", "b.py": "3"}), ("weight_file", {"name": "w"})]
    for field, value in [*changed, *((f, None) for f in APPROVED)]:
        put({k: v for k, v in (APPROVED | {field: value}).items() if v is not None})
        with pytest.raises(scoring.GateError) as e:
            scoring.gate(spark, str(path), APPROVED, revision="v1")
        assert e.value.field == field
    with pytest.raises(scoring.GateError, match="revision"):
        scoring.gate(spark, str(path), APPROVED, revision="main")
    for text in ("[]", "{", ""):
        put(text)
        with pytest.raises(scoring.GateError, match="manifest"):
            scoring.gate(spark, str(path), APPROVED, revision="v1")
    with pytest.raises(scoring.GateError, match="manifest"):
        scoring.gate(spark, str(tmp_path / "none.json"), APPROVED, revision="v1")


def test_a_changed_file_stops_the_query(spark, tmp_path):
    weights = tmp_path / "weights.bin"
    weights.write_bytes(b"w" * 3_000_000)
    files = {str(weights): hashlib.sha256(weights.read_bytes()).hexdigest()}
    assert scoring.score(pairs(spark, 30), short_of_memory(8), files=files).count() == 30
    with pytest.raises(Exception, match="hash is not the reviewed one"):
        scoring.score(pairs(spark, 30), short_of_memory(8), files={str(weights): "0" * 64}).collect()
