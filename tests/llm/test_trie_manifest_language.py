"""Language filters, prefix trie and manifest against brute force, on odd and on planted rows."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from lookbook.llm import language_id, merkle_manifest, prefix_trie


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ---- language filters

WORDS = {"aa": "the of and house river walk green stone", "bb": "der und haus fluss gehen gruen stein nicht", "cc": "дом река идти камень зелёный и не это"}


def sentences(lang, n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS[lang].split()) for _ in range(12)) for _ in range(n)]


def corpus():
    return [(i, text, lang) for i, (lang, text) in enumerate((lang, t) for lang in WORDS for t in sentences(lang, 60, lang))]


def test_languages_of_held_out_texts(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.predict_held_out(docs).collect()}
    assert len(got) == len(rows) and {r["held_out"] for r in got.values()} == {True, False}
    for i, _, lang in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1
    # only the text decides, and held-out labels teach nothing
    wrong = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else lang) for i, t, lang in rows]
    again = language_id.predict_held_out(spark.createDataFrame(wrong, docs.schema)).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in again} == {i: r["lang_pred"] for i, r in got.items()}


def test_filter_holds_what_brute_force_counts(spark):
    rows = corpus()
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5), least_rate=1e-3, least_share=0.1)
    counts = {lang: {} for lang in WORDS}
    for _, text, lang in rows:
        for h in language_id.gram_hashes(text):
            for x in h.tolist():
                counts[lang][x] = counts[lang].get(x, 0) + 1
    rates = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    assert model.languages == sorted(WORDS)
    grams = sorted({g for c in counts.values() for g in c})
    found, extra = model.masks(np.array(grams, np.uint64))[:, 0], 0
    for g, mask in zip(grams, found.tolist(), strict=True):
        top = max(r.get(g, 0) for r in rates.values())
        want = {j for j, lang in enumerate(model.languages) if rates[lang].get(g, 0) >= max(1e-3, 0.1 * top) and g in rates[lang]}
        have = {j for j in range(3) if mask >> j & 1}
        assert want <= have  # a Bloom filter loses nothing
        extra += len(have - want)
    assert extra <= 3 * len(grams) * max(model.wrong) * 3 + 5


def test_false_positives_are_taken_off():
    full = language_id.LanguageFilter(["a", "b"], np.full((64, 1), 1, np.uint64), np.array([0.9, 0.0]), 0, 4)
    seen, total = full.popcounts("some words of a text")
    assert seen.tolist() == [total, 0]
    half = language_id.LanguageFilter(["a", "b"], np.array([[1], [3]] * 32, np.uint64), np.array([0.999, 0.0]), 0, 4)
    seen, total = half.popcounts("some words of a text that goes on for a while")
    assert seen[0] == total and half.decide("some words of a text that goes on for a while")[0] == "a"


def test_odd_texts_and_tables(spark):
    rows = [*corpus(), (1001, None, "aa"), (1002, "", "bb"), (1003, "12 !! ½ ²", "aa"), (1004, "the house", None), (None, "der fluss", "bb"), (None, None, None), (1005, "漢字", "aa"), (1006, "a", None), (1007, "the green river " * 200_000, None), (0, corpus()[0][1], "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"lang_pred": F.lit(1), "score": F.lit("x"), "row": F.lit("r"), "found": F.lit(2)})
    got = language_id.predict_held_out(docs).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "held_out", "lang_pred", "score"}
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1001, 1002, 1003))
    assert by[1004]["lang_pred"] == "aa" and by[1007]["lang_pred"] == "aa" and by[1005]["lang_pred"] in WORDS and by[1006]["lang_pred"] in WORDS
    assert sorted((r["lang_pred"], r["held_out"]) for r in got if r["doc_id"] is None) == [("bb", False), ("und", False)]
    assert language_id.predict_held_out(docs.limit(0)).collect() == []
    unlabelled = language_id.predict_held_out(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in unlabelled} == {("und", 0.0)}
    model = language_id.learn(docs.where("doc_id < 1000"))
    kept = language_id.identify(docs, model)
    assert kept.columns == ["doc_id", "text", "lang", "row", "found", "lang_pred", "score"] and kept.where("row = 'r' and found = 2").count() == len(rows)


def test_chunks_give_the_grams_of_the_whole(monkeypatch):
    text = "the stone house by the river and the walk " * 40
    whole = np.concatenate(list(language_id.gram_hashes(text)))
    monkeypatch.setattr(language_id, "CHUNK", 17)
    assert np.array_equal(np.concatenate(list(language_id.gram_hashes(text))), whole)


def test_over_64_languages_use_more_words(spark):
    rows = [(i, f"{chr(0x4E00 + 40 * (i % 70))}{chr(0x4E01 + 40 * (i % 70))}{chr(0x4E02 + 40 * (i % 70))} " * 5, f"l{i % 70:02}") for i in range(210)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs)
    assert model.bits.shape[1] == 2
    assert all(r["lang_pred"] == r["lang"] for r in language_id.identify(docs, model).collect())


# ---- prefix trie


def brute_trie(rows):
    talks = {}
    for c, t, r, x in sorted((q for q in rows if q[0] is not None), key=lambda q: (q[0], q[1] is not None, q[1] or 0, sha(f"{len((q[2] or '').encode())}:", q[2] or "", q[3] or ""))):
        talks.setdefault(c, []).append((r or "", x or ""))
    built = {}
    for c, turns in talks.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = talks.get(c - c % 5, [])[:h] + turns[h:]
    nodes, kids, below, out = {}, {}, {}, []
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    for p in sorted(nodes, key=len, reverse=True):
        mine = kids.get(p, [])
        leaves = sum(below[q][0] for q in mine) if mine else 1
        saved = (len(nodes[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(below[q][1] for q in mine)
        below[p] = leaves, saved
        ends = sorted(c for c in nodes[p] if len(built[c]) == len(p))
        out.append((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(mine), leaves, saved, sha(",".join(map(str, ends)))))
    return sorted(out, key=repr)


TURNS = "conv_id long, turn long, role string, text string"


def trie_of(spark, rows, **more):
    talks = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("x") for c in ("path", "token", "node", "t", "head")})
    got = prefix_trie.prefix_trie(prefix_trie.share_heads(prefix_trie.turn_paths(talks)), **more)
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_trie_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "höre", "", "go on"])) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(c, 0, "user", "the same") for c in range(100, 160)]  # one large group of copies
    rows += [(c, t, "user", f"turn {t}") for c in range(200, 230) for t in range(12)]  # long common heads
    rows += [(1000, t, "assistant", "é" * t) for t in range(60)]
    rows += [(None, 1, "user", "no id"), (300, None, None, None), (300, None, "user", None), (300, 2, None, "x"), (301, 1, "user", "tie"), (301, 1, "assistant", "tie"), (301, 1, "user", "tie"), (7, 3, "user", "again")]
    want = brute_trie(rows)
    assert trie_of(spark, rows) == want
    assert trie_of(spark, rows, most=0) == want  # splitters too large to be sent to all tasks
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    assert trie_of(spark, rows) == want


def test_trie_of_few_rows(spark):
    assert trie_of(spark, []) == []
    one = [(4, 0, "user", "x")]
    assert trie_of(spark, one) == brute_trie(one)
    turnless = [(c, 0, "user", "x") for c in (1, 2, 3) if zlib.crc32(str(c).encode()) % 9]
    assert turnless and trie_of(spark, turnless) == brute_trie(turnless)  # the head's conversation is absent, and their turn is before h


def test_trie_of_conversations_as_they_are(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b" * 300_000), (2, 0, "user", "a"), (3, 0, "user", "z")]
    got = {(r["conv_id"], r["depth"]): r for r in prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS)).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (3, 1)}
    assert got[1, 1]["n_convs"] == 2 and got[1, 1]["ends_sha256"] == sha("2") and got[1, 0]["n_leaves"] == 2 and got[1, 0]["saved_tokens"] == 1


def test_trie_partitions_do_not_change_it(spark):
    rows = [(c, t, "user", f"{c % 4 if t < 2 else c} {t}") for c in range(80) for t in range(3)]
    before, out = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("2", "9", "31"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(trie_of(spark, rows))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == out[1] == out[2] == brute_trie(rows)


# ---- manifest


def brute_manifest(rows):
    def put(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r):
        return sha(*map(put, (r[0], r[3], r[2], r[4], r[1])))

    def tree(digests):
        levels = [digests]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
        return levels

    def way(levels, i):
        for level in levels[:-1]:
            s = i // 3 * 3
            run = level[s : s + 3]
            yield run[: i - s], run[i - s + 1 :]
            i //= 3

    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: tree([leaf(r) for r in by[s]]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            proof = [*way(trees[s], i), *way(top, k)]
            bent = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            h = leaf((r[0], r[1].replace("\n", ""), *r[2:]) if bent else r)
            for left, right in proof:
                h = sha(*left, h, *right)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], sha(*(x for a, b in proof for x in a + b)), h, h == top[-1][0]))
    return sorted(out, key=repr)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def manifest_of(spark, rows, **more):
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("grp", "place", "total", "digest", "leaf", "block", "proof", "subroot", "root", "tampered")})
    return sorted((tuple(r) for r in merkle_manifest.verified_manifest(docs, **more).collect()), key=repr)


def documents():
    big = 2**61 + 1  # must not pass through a double
    rows = [(i, f"text {i}\n\nmore", "en", "hot", 5) for i in range(big, big + 100)]
    rows += [(i, f"line\n{i}", "fr", f"s{i % 7}é", i) for i in range(40)]
    rows += [(None, "no id\n", "en", "hot", 1), (None, None, None, None, None), (5, None, "en", None, 0), (6, "", None, "", None), (7, "x\ny", "en", None, 3), (7, "x\ny", "en", None, 3), (7, "other", "en", None, 3), (8, "long\n" * 300_000, "en", "lone", 1)]
    return rows


def test_manifest_equals_brute_force(spark):
    want = brute_manifest(documents())
    for levels in (1, 2, 8):
        assert manifest_of(spark, documents(), levels=levels) == want
    assert {r[-1] for r in want} == {True, False}


def test_manifest_of_few_rows(spark):
    assert manifest_of(spark, []) == []
    for n in (1, 2, 3, 4, 9, 10, 28):
        rows = [(i, "a\nb", "en", "s", 1) for i in range(n)]
        assert manifest_of(spark, rows, levels=2) == brute_manifest(rows), n
    rows = [(i, "a", "en", f"{i}", 1) for i in range(11)]  # lone leaves only
    assert manifest_of(spark, rows, levels=1) == brute_manifest(rows)


def test_a_block_serves_its_nodes_by_label():
    digests = [sha(str(i)) for i in range(7)]
    block = merkle_manifest._Block(7, 0, digests, 2, 3)
    ups = [sha(*digests[i : i + 3]) for i in (0, 3, 6)]
    assert block.levels[1] == (0, ups) and block.top == sha(*ups)
    proofs = list(block.proofs(""))
    assert all(merkle_manifest.fold(d, p) == block.top for d, p in zip(digests, proofs, strict=True))
    assert proofs[6] == "<," + ups[0] + ups[1] + "<"
