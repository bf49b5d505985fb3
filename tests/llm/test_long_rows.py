"""Very many hits in one text, embedded elements of pages, and decontamination of rows with null and shared ids."""

import random
import time
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from lookbook.llm import decontaminate, html_text, line_dedup, personal_data, text_pieces

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pieces_of_texts_and_running_values(spark):
    rng = random.Random(5)
    texts = ["", "a", "é\U0001f600" * 4096, "x\n" * 2048, "y" * 4096, "\U0001f600z" * 5000, "w" * 12_288]
    rows = []
    for t in texts:
        for _ in range(12):
            a, b = sorted(rng.randint(0, len(t) + 2) for _ in range(2))
            rows.append((t, a, b))
        rows += [(t, 0, len(t)), (t, 4096, 8192), (t, len(t), len(t)), (t, 5, 2)]
    got = spark.createDataFrame(rows, "t string, a int, b int").select("t", "a", "b", text_pieces.let(text_pieces.chunks(F.col("t")), lambda of: text_pieces.between(of, F.col("a"), F.col("b"))).alias("p")).collect()
    assert all(r["p"] == r["t"][r["a"] : r["b"]] for r in got)
    lists = [([],), ([3],), ([rng.randint(-9, 9) for _ in range(300)],), ([rng.randint(0, 9) for _ in range(64)],), ([1] * 65,)]
    v, n = F.col("v"), F.size("v")
    out = spark.createDataFrame(lists, "v array<int>").select("v", text_pieces.running(v, n, text_pieces.plus).alias("s"), text_pieces.running(v, n, F.greatest).alias("m"), text_pieces.chosen(v, F.lit(0), lambda s, x: x >= s, lambda s, x: F.greatest(s, x), "array<int>", 7).alias("c")).collect()
    for r in out:
        rising, top = [], 0
        for x in r["v"]:
            rising += [x] * (x >= top)
            top = max(top, x)
        assert (r["s"], r["m"], r["c"]) == (list(accumulate(r["v"])), list(accumulate(r["v"], max)), rising)


def test_100_000_hits_in_one_text(spark):
    n = 100_000
    mails = " ".join(f"joe{i}@mail{i % 7}.com" for i in range(n))
    docs = spark.createDataFrame([(1, mails, "en", "x", 1)], DOCS)
    began = time.time()
    found = personal_data.find_personal_data(docs).collect()[0]
    assert found["n_email"] == n and time.time() - began < 40  # 15 s on an idle machine
    assert found["spans"].startswith("email:0:14,email:15:29,") and found["spans"].endswith(f":{len(mails)}")
    began = time.time()
    assert personal_data.mask_personal_data(docs).collect()[0]["text"] == " ".join(["<EMAIL>"] * n) and time.time() - began < 40

    shared = [f"w{i % 997} a{i} b{i} {'c ' * 22}d{i}." for i in range(n)]
    docs = spark.createDataFrame([(1, " ".join(shared), "en", "x", 1), (2, " ".join(f"{s} Only here {i}." for i, s in enumerate(shared)), "en", "x", 1)], DOCS)
    began = time.time()
    left = {r["doc_id"]: r for r in line_dedup.deduplicate(docs).collect()}
    assert time.time() - began < 40
    assert len(left[2]["removed"]) == n and left[2]["text"] == " ".join(f"Only here {i}." for i in range(n)) and not left[1]["removed"]


def test_masks_of_overlapping_spans_and_wide_characters(spark):
    text = "\U0001f600 é " * 3000 + "call +49 30 1234567 or joe@mail.com, card 4111 1111 1111 1111 at 10.1.2.3. " * 300
    out = personal_data.mask_personal_data(spark.createDataFrame([(1, text, "en", "x", 1)], DOCS)).collect()[0]["text"]
    assert out == "\U0001f600 é " * 3000 + "call <PHONE> or <EMAIL>, card <CARD> at <IP>. " * 300


@pytest.fixture(scope="module")
def tree(spark):
    return html_text.train_tree(spark)


PROSE = "Plain words of an article that goes on for a good while and says something new."


@pytest.mark.parametrize(
    "embedded",
    ["<svg/>", '<svg class="x" />', "<svg><path d='M0'/></svg>", "<svg><path/>", "<svg><g/><text>Label", "<button>Share", "<button type=submit>", "<object data=x>", "<object data=x>Fallback", "<select><option>One<option>Two", "<select>", "<iframe src=x>", "<iframe src=x/>", "<noscript>", "<button><div>Share</div></button>", "<object><p>No plugin</p></object>", "<textarea>", "<BUTTON>Share</Button >"],
)
def test_text_after_embedded_elements_stays(tree, embedded):
    page = f"<body><article><h1>Head</h1><p>{PROSE}</p><div>{embedded}</div><p>{PROSE} Second.</p><p>{PROSE} Third.</p></article></body>"
    assert html_text.main_text(page, tree) == f"Head\n{PROSE}\n{PROSE} Second.\n{PROSE} Third."
    inside = f"<article><p>{PROSE}</p>{embedded}<p>{PROSE} Second.</p></article><footer><button>Send</button><select><option>a</select></footer>"
    assert html_text.main_text(inside, tree) == f"{PROSE}\n{PROSE} Second."


def test_raw_elements_without_an_end(tree):
    assert html_text.main_text(f"<article><p>{PROSE}</p><script>var a = '<p>{PROSE}</p>'", tree) == PROSE
    assert html_text.main_text(f"<article><p>{PROSE}</p><!-- <p>{PROSE}</p>", tree) == PROSE


def test_many_embedded_elements_take_linear_time(tree):
    for part in ("<button>", "<svg>", "<svg/>", "<object><select>", "<button></button>", "<iframe>", "<select><option>x", "</article><button>"):
        began = time.time()
        html_text.main_text(part * (1_500_000 // len(part)), tree)
        assert time.time() - began < 10, part


@pytest.mark.parametrize("bound", [0, 500_000])
def test_decontamination_judges_rows(spark, monkeypatch, bound):
    from lookbook.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", bound)
    item = "which river runs through the old town where the seven bridges stand and the market is held"
    clean = "a clean text about birds that fly over the hills in the morning of a fine day"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, f"so {item} then", "en", None, 1), (7, f"{item}", "en", "a", 1), (7, clean, "en", "a", 1), (None, clean, "en", "a", 1), (8, None, None, None, None), (9, "", "en", "a", 0), (10, clean, "en", "a", 1), (10, clean, "en", "a", 1), (11, item, "en", "a", 1), (11, item, "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("key", "w", "row", "item_id", "hash")}).withColumn("void", F.lit(None))
    out = decontaminate.decontaminate(docs, bench)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    assert got == sorted(((r[0], r[1]) for r in rows if not (r[1] and item in r[1])), key=repr)
    assert decontaminate.decontaminate(docs.limit(0), bench).collect() == [] and decontaminate.decontaminate(docs, bench.limit(0)).count() == len(rows)
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()) == [(7, 1), (11, 1)]
