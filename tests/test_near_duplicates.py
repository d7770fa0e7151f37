import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from gradus.functions import text as tx
from gradus.functions import gestalt
from gradus.operators import similar, validate
from gradus.plans import catalog


@pytest.mark.parametrize(("bits", "walked"), [(similar.SIEVE_BITS, gestalt.PAIRS), (1 << 10, -1)])
def test_long_texts_against_brute_force(spark, tmp_path, monkeypatch, bits, walked):
    monkeypatch.setattr(similar, "SIEVE_BITS", bits)
    monkeypatch.setattr(gestalt, "PAIRS", walked)
    draw = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzß" + "".join(map(chr, range(0x4E00, 0x4F00)))  # rare ones, since the matcher anchors on no frequent character
    words = ["".join(draw.choices(letters, k=draw.randint(2, 9))) for _ in range(300)]
    texts = []
    for size in (3, 20, 60, 90, 150, 400):
        for _ in range(4):
            text = " ".join(draw.choices(words, k=size))
            texts += [text, text.upper()]
            for changes in (1, max(1, len(text) // 60), len(text) // 25):
                near = list(text)
                for at in draw.sample(range(len(near)), changes):
                    near[at] = draw.choice("xyz")
                texts.append("".join(near))
    texts += ["", None]
    draw.shuffle(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    plain = [(r.doc_id, r.t) for r in rows.select("doc_id", tx.normalized_question(rows.text).alias("t")).collect() if r.t]
    wanted = {(i, j, round(r, 9)) for i, a in plain for j, b in plain if i < j and (r := SequenceMatcher(None, a, b).ratio()) >= validate.NEAR}
    assert any(len(texts[i]) > 400 and r < 1 for i, _, r in wanted)
    got = [tuple(r) for r in catalog.QUERIES["near_duplicate_docs"](spark, str(tmp_path)).collect()]
    assert set(got) == wanted and len(got) == len(wanted)


def test_normalised_questions(spark):
    import re
    import unicodedata

    draw = random.Random(8)
    letters = [*"aZ09_ .,!?-\n\x00", "é", "ß", "ẞ", "Þ", "ÿ", "×", "÷", "«", "½", "µ", "ª", "\xa0", "ﬁ", "Ａ", "ก", "๑", "ั", "日", "İ", "Σ", "ς", "𝒳"]
    texts = ["".join(draw.choices(letters if n % 2 else letters[:19], k=draw.randint(0, 20))) for n in range(2000)] + ["", None]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    rows = spark.createDataFrame([(t,) for t in texts], "text string").unionByName(docs).select("text", tx.normalized_question(F.col("text")).alias("t")).collect()
    for r in rows:
        assert r.t == re.sub(r"[^\w\u0E00-\u0E7F]+", "", unicodedata.normalize("NFKC", r.text or "").casefold()), r.text


@pytest.mark.parametrize("walked", [gestalt.PAIRS, -1])
def test_ratios_end_early(monkeypatch, walked):
    monkeypatch.setattr(gestalt, "PAIRS", walked)
    draw = random.Random(9)
    for n in (0, 3, 40, 199, 200, 600):
        for letters in ("ab", "abcdefghij", "".join(map(chr, range(0x4E00, 0x4F00)))):
            for changes in (0, 2, n // 30, n // 4):
                a = draw.choices(letters, k=n)
                b = list(a)
                for _ in range(changes):
                    at = draw.randrange(len(b) + 1)
                    b[at : at + draw.randint(0, 1)] = draw.choice(("", "x", letters[0]))
                a, b = "".join(a), "".join(b)
                whole = SequenceMatcher(None, a, b).ratio()
                assert gestalt.ratio(a, b) == whole
                assert gestalt.ratio(a, b, 0.95) == (whole if whole >= 0.95 else 0) and gestalt.ratio(a, b, whole) == whole


def test_only_pairs_leave_a_block():
    """Characters don't move: a task hands on pairs that pass the counts of characters and runs, and every band's blocks hold a bounded share."""
    draw = random.Random(5)
    words = ["".join(draw.choices("etaoinshrdlu", k=draw.randint(2, 9))) for _ in range(300)]
    passage = "".join(draw.choices(words, k=10))  # in all texts, at about the same place
    texts = ["".join(draw.choices(words, k=40)) + passage + "".join(draw.choices(words, k=60)) for _ in range(60)]
    near = texts[0][:100] + "x" + texts[0][101:]
    rows = [(i, 0, len(t), similar.zlib.compress(t.encode(), 1)) for i, t in enumerate([*texts, near])]
    block = similar._Block(rows, 0.95, similar.SIEVE_BITS)
    x, of = block.met(rows)
    assert list(zip(x.tolist(), of.tolist(), strict=True)) == [(0, 60)]
    sizes = {10: 100, 11: 900 * similar.SMALL, 12: 50}
    blocks = similar._blocks(sizes)
    assert {b: {r[3] for r in blocks if r[0] == b} for b in sizes} == {10: {1}, 11: {16}, 12: {1}}
    assert sorted(r[1] for r in blocks if r[0] == 12) == list(range(1, 18)) and sorted(r[1] for r in blocks if r[0] == 11) == list(range(17))
