"""The dealt operators on hand-made rows, against brute force: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash

from lookbook.llm import chat_format, decontaminate, license_scan, line_dedup, mixture, personal_data, quality_rules, simhash_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, n_words string, size string, row string, s string, _all string, block string, item string"


def table(spark, texts, ids=None, sources=None):
    rows = [(i if ids is None else ids[i], t, "en", "a" if sources is None else sources[i], None if t is None else len(t), *["x"] * 7, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words_of(rng, n):
    return [rng.choice(["alpha", "beta", "gamma", "delta", "of", "the", "and", "epsilon", "zeta", "eta", "theta", "iota", "kappa"]) + rng.choice(["", "s", "ed", "ly", "."]) for _ in range(n)]


def some_texts(seed=1, n=60):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            w = rng.choice(out).split(" ")
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(["new", "other", "Word"])
            out.append(" ".join(w))
        else:
            out.append(" ".join(words_of(rng, rng.randint(1, 300))))
    return [*out, None, "", " \n\t", "one", "one two", "ONE two", out[0], "long " * 30_000, " x éÉ \U0001f600"]


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, prints):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(ids))]


@pytest.mark.parametrize(("block_rows", "splits"), [(1024, 20), (3, 20), (2, 2)])
def test_simhash_components(spark, monkeypatch, block_rows, splits):
    monkeypatch.setattr(simhash_dedup, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(simhash_dedup, "SPLITS", splits)
    texts = some_texts()
    ids = [1000 - 7 * i for i in range(len(texts))]
    ids[5], ids[9] = None, ids[8]
    got = sorted(map(str, ((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash_dedup.near_duplicates(table(spark, texts, ids)).collect())))
    prints = [brute_fingerprint(t) for t in texts]
    assert got == sorted(map(str, zip(ids, prints, brute_components(ids, prints), strict=True)))


def test_simhash_links_connect_dense_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "BLOCK_ROWS", 16)
    rng = random.Random(3)
    prints = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(40):
            prints.add(x)
            x ^= 1 << rng.randrange(64)
            x ^= 1 << rng.randrange(64)
    prints = sorted(prints)
    frame = spark.createDataFrame([(simhash_dedup._signed(p),) for p in prints], "fp long")
    links = simhash_dedup.links(frame).collect()
    assert len(links) <= 20 * 3 * len(prints)
    assert all((r["a"] ^ r["b"]) % (1 << 64) and ((r["a"] ^ r["b"]) % (1 << 64)).bit_count() <= 3 for r in links)
    from lookbook.llm.components import components

    roots = {r["node"] % (1 << 64): r["root"] for r in components(simhash_dedup.links(frame)).collect()}
    want = brute_components(list(range(len(prints))), prints)
    by = {}
    for p, w in zip(prints, want, strict=True):
        by.setdefault(roots.get(p, ("alone", p)), set()).add(w)
    assert all(len(v) == 1 for v in by.values()) and len(by) == len(set(want))


def test_simhash_deals_a_hot_cell_into_bounded_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "BLOCK_ROWS", 64)
    rng = random.Random(11)
    prints = sorted({0x123456789 << 28 | rng.getrandbits(28) for _ in range(4000)})  # agree in 36 bits
    near = [rng.choice(prints) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(200)]
    frame = spark.createDataFrame([(simhash_dedup._signed(p),) for p in sorted({*prints, *near})], "fp long")
    dealt, n = simhash_dedup.deal(simhash_dedup.pivot_table(frame))
    rows = [(r["fp"] % (1 << 64), r["block"]) for r in dealt.select("fp", "block").collect()]
    assert len(rows) == n < 20 * len(prints) * 30  # a grid alone would make 62 copies of a row of the hot cells
    blocks = Counter(b for _, b in rows)
    assert max(blocks.values()) <= 2 * 64 * 1.5
    at = {}
    for p, b in rows:
        at.setdefault(p, set()).add(b)
    every = sorted(at)
    for p in near:
        assert all(at[p] & at[q] for q in every if 0 < (p ^ q).bit_count() <= 3)


def test_simhash_empty_and_dedup(spark):
    assert simhash_dedup.near_duplicates(table(spark, []).limit(0)).collect() == []
    docs = table(spark, ["a b c d", "a b c d", None, "", "quite other words here"], [4, 2, 9, 9, 9])
    kept = simhash_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 9, 9]  # of 9 one of the empty texts and the other text
    odd = ["a b c d", "a b c d", "other words than these", "other words than these", "x y z", "x y z", "x y z", None]
    kept = simhash_dedup.deduplicate(table(spark, odd, [3, None, 3, 1, None, None, None, None]))
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == [("1", "other words than these"), ("3", "a b c d"), ("None", "None"), ("None", "x y z")]
    assert simhash_dedup.deduplicate(docs.limit(0)).collect() == []


def brute_stats(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if grams[tuple(w[i : i + 8])] > 1:
            hit |= set(range(i, i + 8))
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_quality_statistics_and_verdicts(spark):
    rng = random.Random(5)
    good = [" ".join(w + ("." if rng.random() < 0.1 else "") for w in words_of(rng, 200)) for _ in range(60)]
    junk = [" ".join(f"{w}***" for w in words_of(rng, 80)) for _ in range(3)] + [" ".join(f"{w.upper()}!!" for w in words_of(rng, 80)) for _ in range(3)]
    odd = [None, "", "a b c d e f g h " * 30, "x\nx\n\n \nx\ny", "é 😀 #|", "one two three four five six seven eight nine ten " * 2 + "tail " * 40]
    texts = [*good, *junk, *odd, "w" * 100_000, "same words over " * 20_000]
    rows = {r["doc_id"]: r for r in quality_rules.score_quality(table(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        if len(t or "") < 90_000:
            want = brute_stats(t)
            assert tuple(rows[i][c] for c in quality_rules.BASE) == want, i
            assert rows[i]["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
    assert all(rows[i]["kept"] for i in range(60))
    assert not any(rows[i]["kept"] for i in range(60, 60 + len(junk)))
    docs = table(spark, texts)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in rows.items() if r["kept"])
    assert quality_rules.score_quality(docs.limit(0)).collect() == []


def brute_personal(text):
    text, found = text or "", []
    luhn = lambda d: sum(v if k % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for k, v in enumerate(int(c) for c in reversed(d))) % 10 == 0
    ok = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m)),
        "phone": lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for kind in personal_data.KINDS:
        found += [(kind, m.start(), m.end()) for m in re.finditer(plain[kind], text) if ok[kind](m[0])]
    return found


def test_personal_data_base_spans(spark):
    rng = random.Random(2)
    alphabet = ["a", "b.", "@", "1", "23", "4", ".", "-", "+", " ", "(", ")", "é", "😀", "x@y.z", "10.0.0.1", "+1 (555) 010-2030", "4111 1111 1111 1111", "4111111111111111", "%", "\n", "256.1.1.1", "a@b.c+d@e.f"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts += [None, "", "7" * 30_000, "a" * 50_000 + "@", "call me: (523) 555-1055 or mail joe [at] mail [dot] com", "0300.1.1.1 0.0.0.0 1.2.3.4.5.6.7.8", "x@y.z " * 500]
    rows = {r["doc_id"]: r for r in personal_data.find_personal_data(table(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        want = brute_personal(t)
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert [rows[i][f"n_{k}"] for k in personal_data.KINDS] == [sum(w[0] == k for w in want) for k in personal_data.KINDS], t
        assert rows[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), t
        assert set(filter(None, listed.split(","))) <= set(filter(None, rows[i]["spans"].split(",")))
    assert personal_data.find_personal_data(table(spark, texts).limit(0)).collect() == []


def test_personal_data_mask(spark):
    texts = ["mail joe@mail.com now", None, "", "nothing", "from 10.0.0.1 to +1 (555) 010-2030.", "😀 a@b.cd 😀 4111 1111 1111 1111"]
    docs = table(spark, texts)
    out = personal_data.mask_personal_data(docs)
    assert out.columns == docs.columns
    rows = {r["doc_id"]: r for r in out.collect()}
    assert [rows[i]["text"] for i in range(6)] == ["mail <EMAIL> now", None, "", "nothing", "from <IP> to <PHONE>.", "😀 <EMAIL> 😀 <CARD>"]
    assert rows[0]["n_chars"] == len("mail <EMAIL> now") and rows[3]["n_chars"] == 7


ADDED = [
    ("call me: {}", "phone", "(523) 555-1055"), ("phone {}", "phone", "523.555.1055"), ("tel: {}", "phone", "0044 20 7946 0958"), ("write to {} please", "email", "joe [at] mail [dot] com"), ("mail joe {} now", "email", "jane.doe at example dot org"),
    ("host {} is up", "ip", "2001:db8:0:0:8:800:200c:417a"), ("login from {}", "ip", "2001:db8::8a2e:370:7334"), ("IBAN {}", "iban", "DE89 3704 0044 0532 0130 00"), ("account {}", "iban", "GB29NWBK60161331926819"),
    ('token = "{}"', "secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962"), ("password: {}", "secret", "ghp_16C7e42F292c6912E7710c838347Ae178B4a"), ("card no {}", "card", "3782 822463 10005"),
]
REFUSED = [
    ("on {} we met", "2024-01-15"), ("since {}", "12/31/1999"), ("at {} sharp", "12:30:45"), ("order {} came", "9807915762804491"), ("isbn {}", "978 3161 48410"), ("the {} said", "Donaudampfschifffahrtsgesellschaft2"), ("item {}", "8888 8888 8888 8889"),
    ("code {}", "DE00 3704 0044 0532 0130 00"), ("pages {}", "1999/2001"), ("version {}", "10 20"), ("user {}", "root@localhost"), ("build {}", "aaaaaaaaaaaaaaaaaaaaaaa1"),
]


def test_personal_data_added_and_refused_spans(spark, monkeypatch):
    rng = random.Random(3)
    fill = lambda: " ".join(words_of(rng, 8))
    known = ["a@mail.com", "10.1.2.3", "4111 1111 1111 1111", "+1 (555) 010-2030"]
    texts = [f"{fill()} {rng.choice(known)} {fill()}" for _ in range(150)]
    where = {}
    for _ in range(8):
        for form, *rest in [*ADDED, *REFUSED]:
            before = f"{fill()}, {form.split('{}')[0]}"
            where[len(texts)] = (rest[0] if len(rest) > 1 else None, len(before), len(before) + len(rest[-1]))
            texts.append(before + rest[-1] + form.split("{}")[1] + f" {fill()}")
    docs = table(spark, texts)
    spans = {r["doc_id"]: r["spans"] for r in personal_data.find_personal_data(docs).collect()}
    wrong = [(texts[i], kind, spans[i]) for i, (kind, s, e) in where.items() if spans[i] != (f"{kind}:{s}:{e}" if kind else "")]
    assert not wrong
    masked = {r["doc_id"]: r["text"] for r in personal_data.mask_personal_data(docs).collect()}
    assert all(masked[i] == (texts[i][:s] + f"<{kind.upper()}>" + texts[i][e:] if kind else texts[i]) for i, (kind, s, e) in where.items())
    base = {r["doc_id"]: r["base_sha256"] for r in personal_data.find_personal_data(docs).collect()}
    for verdict in (True, False):  # both kinds of spans hang on the classifier
        monkeypatch.setattr(personal_data.SpanModel, "accepts", lambda self, c, v=verdict: (c["digits"] >= 0) == v)
        rows = personal_data.find_personal_data(docs).collect()
        assert any(r["spans"] != spans[r["doc_id"]] for r in rows) and all(r["base_sha256"] == base[r["doc_id"]] for r in rows)


def brute_leaks(texts, items):
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    grams = lambda w, n: {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}
    out, seen = set(), {}
    for j, t in enumerate(items):
        seen.setdefault(tuple(split(t)), j)
    for w, j in seen.items():
        n = min(5, len(w))
        for i, t in enumerate(texts):
            if n and len(grams(w, n) & grams(split(t), n)) >= 0.8 * len(grams(w, n)) - 1e-9:
                out.add((i, j, len(grams(w, n)), len(grams(w, n) & grams(split(t), n))))
    return out


@pytest.mark.parametrize("bound", [500_000, 0])
def test_decontamination(spark, monkeypatch, bound):
    monkeypatch.setattr("lookbook.llm.common.BROADCAST_ROWS", bound)
    rng = random.Random(8)
    items = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * 2 for _ in range(n)) for n in (5, 6, 9, 17, 33, 70, 1, 3)] + [None, "", "..."]
    items.append(items[2].upper())
    texts = []
    for _ in range(80):
        w = [rng.choice("abcdefghijklmnopqrstuvwxyz") * 2 for _ in range(rng.randint(0, 400))]
        t = (rng.choice(items) or "").split()
        for _ in range(rng.randint(0, 2)):
            if t:
                t[rng.randrange(len(t))] = "changed,"
        at = rng.randint(0, len(w))
        texts.append(" ".join([*w[:at], *t, *w[at:]]))
    texts += [None, "", items[5] + "\n" + items[5], items[3].replace(" ", " *** ")]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["n_shingles"], r["n_found"]) for r in decontaminate.leaks(table(spark, texts), bench).collect()}
    assert got == brute_leaks(texts, items)
    assert {r[:4] for r in by_sql(table(spark, texts), "op8_decontaminate", bench)} == got
    kept = decontaminate.decontaminate(table(spark, texts), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(range(len(texts))) - {x[0] for x in got})
    long = "filler words of no meaning at all " * 30_000
    odd = [items[5], items[5] + " and more", items[4], None, f"{long}{items[7]} xx {items[2]} {long}"]
    pairs = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(table(spark, odd, [7, 7, None, None, 8]), bench).collect()}
    assert pairs == {((7, 7, None, None, 8)[i], j) for i, j, _, _ in brute_leaks(odd, items) if i not in (2, 3)}  # a repeated id once; without id none
    assert {(7, 5), (8, 7), (8, 2)} <= pairs
    left = decontaminate.decontaminate(table(spark, odd, [7, 7, None, None, 9]).drop("item"), bench).collect()
    assert [(r["doc_id"], r["text"]) for r in left] == [(None, None)]  # a contaminated row without an id goes as well
    assert decontaminate.leaks(table(spark, texts), bench.limit(0)).collect() == []
    assert decontaminate.leaks(table(spark, texts).limit(0), bench).collect() == []


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight, total = {s: i % 3 + 1 for i, s in enumerate(order)}, sum(sizes.values())
    stopped = set()
    while True:
        left, open_ = total - sum(3 * sizes[s] for s in stopped), [s for s in order if s not in stopped]
        target = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if target[s] > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] for s in stopped} | target
        stopped |= over


def brute_schedule(blocks):
    """Source and block of each owned slot, by van der Corput points over the blocks of each source in order."""
    owner = [s for s, n in sorted(blocks.items()) for _ in range(n)]
    bits = max(len(owner) - 1, 0).bit_length()
    rank, out = Counter(), {}
    for slot in range(2**bits):
        point = int(format(slot, f"0{bits}b")[::-1], 2) if bits else 0
        if point < len(owner):
            out[owner[point], rank[owner[point]]] = slot
            rank[owner[point]] += 1
    return out


def brute_mix(spark, named, block, runs):
    """(slot, sid, block, rid, words) of each piece; the shuffled order takes Spark's hash of the ids."""
    rows = [(r["rid"], r["doc_id"], r["size"], r["sid"], r["target"], r["source_size"], t) for r in named for t in range(3) if r["size"]]
    frame = spark.createDataFrame(rows, "rid long, doc_id long, size long, sid int, target double, source_size long, turn int")
    streams = {}
    for r in frame.selectExpr("*", "xxhash64(doc_id, size, turn) mark").collect():
        streams.setdefault(r["sid"], []).append((r["turn"], r["mark"] % runs, r["mark"], r["rid"], r["size"], round(r["target"])))
    slots = brute_schedule({s: -(-x[0][5] // block) for s, x in streams.items()})
    out = Counter()
    for sid, parts in streams.items():
        words = [rid for _, _, _, rid, size, _ in sorted(parts) for _ in range(size)][: parts[0][5]]
        for i, rid in enumerate(words):
            if (sid, i // block) in slots:
                out[slots[sid, i // block], sid, i // block, rid] += 1
    return sorted((*k, n) for k, n in out.items())


@pytest.mark.parametrize(("run", "span"), [(64, 1024), (2, 2)])
def test_mixture(spark, monkeypatch, run, span):
    monkeypatch.setattr(mixture, "RUN", run)
    monkeypatch.setattr(mixture, "SPAN", span)
    rng = random.Random(4)
    sources = [rng.choice(["a", "b", "b", "b", "b", "c", "dé", "Z", None]) for _ in range(300)] + ["tiny", "none", "none"]
    texts = [" ".join(["w"] * rng.randint(0, 900)) for _ in range(299)] + ["w " * 40_000, "one two", None, ""]
    ids = [i // 2 for i in range(len(texts))]
    ids[4] = None
    docs = table(spark, texts, ids, sources)
    rows = mixture.mixed_sizes(docs, 100).collect()
    assert len(rows) == len(texts)
    sizes = Counter()
    for s, t in zip(sources, texts, strict=True):
        sizes[s] += len((t or "").split())
    want = brute_targets(dict(sizes))
    named, pieces = mixture.mix(docs, 100)
    by_rid, held = {r["rid"]: r for r in named.collect()}, Counter()
    for p in pieces.collect():  # a tiny document may be in a block once a pass
        held[p["slot"], p["sid"], p["block"], p["rid"]] += p["words"]
    got = sorted((*k, n) for k, n in held.items())
    assert got == brute_mix(spark, by_rid.values(), 100, -(-sum(sizes.values()) // (100 * run)))
    taken = Counter()
    for _, sid, _, _, n in got:
        taken[sid] += n
    order = sorted(s for s in want if s is not None) + [None]
    for sid, s in enumerate(order, 1):
        assert taken[sid] == round(want[s]), s
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    assert all(abs(r["target"] - min((want[s] for s in order), key=lambda t: abs(t - r["target"]))) < 1e-6 for r in rows)
    again = mixture.mixed_sizes(docs.repartition(3), 100).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    slots = {(slot, sid, block) for slot, sid, block, _, _ in got}
    assert len({slot for slot, _, _ in slots}) == len(slots)
    assert mixture.mixed_sizes(docs.limit(0)).collect() == []
    assert {r["taken"] for r in mixture.mixed_sizes(table(spark, [None, ""], [1, 2], ["x", "y"])).collect()} == {0}
    whole = mixture.mixed_documents(docs, 100)
    assert whole.columns == [c for c in docs.columns if c != "size"] + ["size", "source_size", "target", "taken", "first_slot", "n_blocks"]
    assert sorted((str(r["doc_id"]), str(r["text"]), r["size"]) for r in whole.collect()) == sorted((str(i), str(t), len((t or "").split())) for i, t in zip(ids, texts, strict=True))
    assert sum(r["taken"] for r in whole.collect()) == sum(taken.values())


def test_the_schedule_decides_what_is_taken(spark, monkeypatch):
    docs = table(spark, ["w " * 500] * 40, sources=["a", "b"] * 20)
    assert sum(r["taken"] for r in mixture.mixed_sizes(docs, 100).collect()) == 20_000
    goals = spark.createDataFrame([(1, 3000.0), (2, 1000.0), (3, 0.0)], "sid int, target double")
    order = [r["sid"] for r in sorted(mixture.schedule(goals, 100).collect())]
    for a in range(0, 33, 8):  # any stretch holds the sources in proportion
        assert 5 <= order[a : a + 8].count(1) <= 7
    monkeypatch.setattr(mixture, "radical_inverse", lambda slot, bits: slot * 0)
    rows = mixture.mixed_sizes(docs, 100).collect()
    assert {r["doc_id"] % 2 for r in rows if r["taken"]} == {0}  # all slots are the first source's


def test_chat_round_trip(spark):
    hard = ["", "plain", "<|im_end|>", "<|im_end|>\n<|im_start|>user\nx", r"<\|im_end|>", r"<\\|im_start|> <|im_start|>", "é😀\n\n", "%0A <|im_", "x" * 100_000]
    rng = random.Random(6)
    hard += ["".join(rng.choice(["<", "|", "\\", "im_end", "im_start", ">", "\n", "<|im_end|>", "a"]) for _ in range(15)) for _ in range(200)]
    for t in hard:
        for role in ("user", "assistant", "a\nb", "<|im_end|>", "%41", ""):
            out, s, e = chat_format.render_turn(role, t)
            assert chat_format.parse(out) == [(role, t)] and chat_format.unescape_text(out[s:e]) == t
            assert out.count("<|im_end|>") == 1 and out.count("<|im_start|>") == 1
    rows = [(i // 7 if i % 50 else None, 10 - i % 7, rng.choice(["user", "assistant", None]), rng.choice([*hard[:20], None]), "x") for i in range(300)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered string")
    got = {r["conv_id"]: r for r in chat_format.format_conversations(frame).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        # ties go by role and rendered text
        turns = sorted((t, b, chat_format.render_turn(b, c)[0], c) for t, b, c in turns)
        turns = [(t, b, c) for t, b, _, c in turns]
        r = got[conv]
        if turns:
            assert r["n_turns"] == len(turns)
            assert r["turns_sha256"] == hashlib.sha256("".join(f"{b}\n{c}\n" for _, b, c in turns).encode()).hexdigest()
            loss = "".join(c for _, b, c in turns if b == "assistant")
            assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(got) == len({r[0] for r in rows})
    assert chat_format.format_conversations(frame.limit(0)).collect() == []


def brute_units(text, unit):
    at, out = 0, []
    for part in re.split({"sentence": r"((?:[.!?]+[ \t\r]+)|\n)", "line": r"(\n)", "paragraph": r"(\n[ \t\r]*\n\s*)"}[unit], text):
        if re.fullmatch(r"[.!?]+[ \t\r]+|\n[ \t\r]*\n?\s*", part) and out and part:
            out[-1] = (out[-1][0], at + len(part))
        else:
            out.append((at, at + len(part)))
        at += len(part)
    return [x for x in out if x[0] < x[1]]


def brute_line_dedup(ids, texts, unit, min_words):
    seen, lists = {}, {}
    for i, t in sorted({(i, t) for i, t in zip(ids, texts, strict=True) if t}, key=lambda x: (x[0] is None, x[0] or 0)):
        units = [(s, e, tuple(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t[s:e])))) for s, e in brute_units(t, unit)]
        units = [u for u in units if len(u[2]) >= line_dedup.LEAST]
        lists[i, t] = [(s, e, len(w), seen.setdefault(w, (i, t, k)), k) for k, (s, e, w) in enumerate(units)]
    out = {}
    for (i, t), units in lists.items():
        gone, run = [], []
        for s, e, n, kept, k in [*units, (0, 0, 0, (i, t, -1), -1)]:
            if kept != (i, t, k):
                run.append((s, e, n, kept))
                continue
            if run and sum(x[2] for x in run) >= min_words:
                gone.append((run[0][0], run[-1][1], run[0][3][0], run[0][3][2]))
            run = []
        new, at = "", 0
        for s, e, *_ in gone:
            new, at = new + t[at:s], e
        out[i, t] = (new + t[at:], gone)
    return [(i, *out.get((i, t), (t, []))) for i, t in zip(ids, texts, strict=True)]


@pytest.mark.parametrize("unit", ["sentence", "line", "paragraph"])
@pytest.mark.parametrize("bound", [500_000, 0])
def test_line_dedup(spark, monkeypatch, unit, bound):
    monkeypatch.setattr("lookbook.llm.common.BROADCAST_ROWS", bound)
    rng = random.Random(9)
    pool = [" ".join(words_of(rng, rng.randint(1, 14))).replace(".", "") for _ in range(40)]
    texts = []
    for _ in range(40):
        parts = [rng.choice(pool) if rng.random() < 0.7 else " ".join(words_of(rng, 9)) for _ in range(rng.randint(1, 25))]
        texts.append("".join(p + rng.choice([". ", ".\n", "\n", "! ", "\n\n"]) for p in parts) + rng.choice(["", "tail \U0001f600"]))
    texts += [None, "", " \n ", texts[0], texts[1].upper(), texts[2], texts[3], "\n".join(pool[:3] * 3000)]
    ids = [500 - 3 * i for i in range(len(texts))]
    ids[7], ids[8], ids[9], ids[43] = None, None, ids[10], ids[0]  # without id; one id with two texts; a row twice
    docs = table(spark, texts, ids).withColumnsRenamed({"fp": "gone", "row": "mark", "item": "kept", "block": "words"})
    rows = line_dedup.deduplicate(docs, unit, 12).collect()
    got = [(r["doc_id"], r["text"], [tuple(g) for g in r["removed"]]) for r in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_line_dedup(ids, texts, unit, 12)))
    assert any(r["removed"] for r in rows) and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)
    assert line_dedup.deduplicate(docs, unit).columns == [*docs.columns, "removed"]
    assert line_dedup.deduplicate(docs.limit(0), unit).collect() == []


def test_line_dedup_finds_passages_inside_lines(spark):
    rng = random.Random(10)
    made = lambda n: ". ".join(" ".join(words_of(rng, 9)).replace(".", "") for _ in range(n))
    passage, notice = made(7), made(1)
    texts = [f"{made(4)}. {passage}. {made(2)}", f"own words here. {notice}. {made(3)}", f"Others begin. {passage}. And they end.", f"{made(3)}. {notice}."]
    rows = {r["doc_id"]: r for r in line_dedup.deduplicate(table(spark, texts)).collect()}
    assert [rows[i]["text"] == t for i, t in enumerate(texts)] == [True, True, False, True]  # one short unit in common is no passage
    assert rows[2]["text"] == "Others begin. And they end." and [g["kept_doc_id"] for g in rows[2]["removed"]] == [0]


def test_license_scan(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    bsd = [license_scan.SENTENCES[k] for k in ("bsd-0", "bsd-1", "bsd-2", "bsd-3")]
    texts = [f"x. {mit}\n{license_scan.SENTENCES['mit-2']}.\n{license_scan.SENTENCES['as-is']}.", ". ".join(bsd) + ".", "Released under the MIT License.\nAll rights reserved.", mit, None, "", "all rights reserved " * 5000]
    got = sorted((r["doc_id"], r["license"], r["first_sentence"], r["n_sentences"]) for r in license_scan.scan_licenses(table(spark, texts)).collect())
    assert got == [(0, "mit", 1, 3), (1, "bsd-3-clause", 0, 4), (2, "mit", 0, 1), (2, "proprietary", 1, 1)]
    assert license_scan.scan_licenses(table(spark, texts).limit(0)).collect() == []


MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE FOR ANY CLAIM.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law
"""
GPL = """ * This program is free software{} you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation{} either version {} of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
"""


MORE = {
    "isc": ("""Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT
""", "isc", "text"),
    "mpl": ("""/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
""", "mpl-2.0", "header s"),
    "lgpl": ("""# This library is free software; you can redistribute it and/or
# modify it under the terms of the GNU Lesser General Public
# License as published by the Free Software Foundation; either
# version 2.1 of the License, or (at your option) any later version.
#
# This library is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
""", "lgpl-2.1-or-later", "header"),
    "agpl": (GPL.format(":", ",", 3).replace("GNU General Public License as", "GNU Affero General Public License as"), "agpl-3.0-or-later", "header"),
    "unlicense": ("""This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
""", "unlicense", "text"),
    "zlib": ("""  This software is provided 'as-is', without any express or implied
  warranty.  In no event will the authors be held liable for any damages
  arising from the use of this software.

  Permission is granted to anyone to use this software for any purpose,
  including commercial applications, and to alter it and redistribute it
  freely, subject to the following restrictions:
""", "zlib", "text"),
    "boost": ("// Distributed under the Boost Software License, Version 1.0.\n// (See accompanying file", "bsl-1.0", "notice"),
    "cc": ("This work is licensed under a Creative Commons\nAttribution-NonCommercial-ShareAlike 4.0 International License.", "cc-by-nc-sa-4.0", "notice"),
    "tag": ("<!-- SPDX-License-Identifier: CC-BY-SA-4.0 -->", "cc-by-sa-4.0", "spdx"),
}


def by_sql(docs, name, items=None):
    import duckdb
    import pandas as pd

    from lookbook.llm import queries

    db = duckdb.connect()
    db.register("documents", pd.DataFrame([(r["doc_id"], r["text"]) for r in docs.collect()], columns=["doc_id", "text"]))
    if items is not None:
        db.register("benchmark", pd.DataFrame([(r["item_id"], r["text"]) for r in items.collect()], columns=["item_id", "text"]))
    return db.sql(queries.oracle_sql()[name]).fetchall()


def test_license_scan_of_more_licences(spark):
    assert len(license_scan.SENTENCES) >= 60 and {s for _, _, ids in license_scan.RULES for s in ids} == set(license_scan.SENTENCES)
    assert all(license_scan.normalise(s) == s for s in license_scan.SENTENCES.values())
    texts = [t for t, _, _ in MORE.values()]
    ids = list(range(len(texts)))
    docs = table(spark, [*texts, texts[0], texts[0], texts[1]], [*ids, 0, 99, None])  # a row twice, a copy, a row without id
    got = sorted((r["doc_id"], r["license"], r["rule"]) for r in license_scan.scan_licenses(docs).collect())
    assert got == sorted([*((i, lic, rule) for i, (_, lic, rule) in enumerate(MORE.values())), (99, "isc", "text")])


def test_license_scan_of_wrapped_texts_and_spdx_lines(spark):
    texts = {
        "MIT": (MIT, [("mit", "text")]), "bsd2": (BSD, [("bsd-2-clause", "text")]), "bsd3": (BSD + BSD3, [("bsd-3-clause", "text")]), "brackets": (BSD.replace("1.", "1)").replace("2.", "(2)"), [("bsd-2-clause", "text")]),
        "crlf": (MIT.replace("\n", "\r\n"), [("mit", "text")]), "apache": (APACHE, [("apache-2.0", "header")]), "gpl3": (GPL.format(":", ",", 3), [("gpl-3.0-or-later", "header")]), "gpl2": (GPL.format(";", ";", 2), [("gpl-2.0-or-later", "header")]),
        "spdx": ("// SPDX-License-Identifier: MIT\n#include <x>", [("mit", "spdx")]), "spdx2": ("/* SPDX-License-Identifier: Apache-2.0 */", [("apache-2.0", "spdx")]), "spdx3": ("# SPDX-License-Identifier: GPL-3.0-or-later\n", [("gpl-3.0-or-later", "spdx")]),
        "other": ("SPDX-License-Identifier: MITX", []), "apart": (BSD.replace("1. Red", "Words between. Red"), []), "twice": ("All rights\nreserved.\n\nAll rights reserved.", [("proprietary", "reserved")] * 2),
    }
    docs = table(spark, [*(t for t, _ in texts.values()), *(t for t, _, _ in MORE.values())])
    got = license_scan.scan_licenses(docs).collect()
    assert sorted(map(tuple, got)) == sorted(by_sql(docs, "op6_license_scan"))
    found = {name: sorted((r["license"], r["rule"]) for r in got if r["doc_id"] == i) for i, name in enumerate(texts)}
    assert found == {name: want for name, (_, want) in texts.items()}
