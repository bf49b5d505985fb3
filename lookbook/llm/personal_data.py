"""Personal data in text: labelers vote on candidate spans, EM weighs them and trains a span classifier.

1. Base spans: the four grammars below, leftmost and non-overlapping per kind, with their checks. They always stay.
2. Candidates: the base matches plus looser forms of these kinds (spelled-out addresses, IPv6, card numbers of other lengths
   or with a wrong check digit, numbers in groups) and two more kinds, bank accounts (IBAN) and secrets (long keys). Most
   numbers in groups aren't telephone numbers, and most long words aren't keys: candidates are of both classes.
3. Labelers vote +1, -1 or abstain: regex (a form that says what it is), check (Luhn, mod 97, groups, digit counts),
   gazetteer (domain endings, issuer digits, calling codes, countries, key prefixes), context (cue words before the span, for
   and against), edges (letters or digits that touch it) and variety (few different characters, or many).
4. EM over the counts of (kind-free) vote patterns estimates how reliable each labeler is on both classes, beginning with the
   balance of the votes; the posteriors are the training labels of a logistic regression over votes, kinds and digits, weighted
   by count. It decides on candidates.

All of it is DataFrame, SQL and Spark ML (JVM) work; only pattern counts, at most a few thousand rows, reach the driver.
Everything about a document stays in its own row, so nothing is joined or shuffled but the pattern counts.
"""

from __future__ import annotations

from math import exp

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, packed, stored, unpacked
from .text_pieces import between, chosen, chunks, let, plus, running
from .vote_model import VoteModel, fit

KINDS = ("email", "ip", "card", "phone")
#: All kinds, as listed.
ALL_KINDS = (*KINDS, "iban", "secret")
#: Fixed grammars. Possessive repeats and the look-behind (a match starts a run or follows a match) give the same leftmost
#: matches as the plain forms, without their quadratic retries inside a run and without recursion on long ones.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap look for what any match must contain.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Looser forms by kind: (whether the form says what it is, a cheap look for what it must contain, pattern).
LOOSE = {
    "email": [
        (True, r"[(\[]at[)\]]", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[(\[]dot[)\]]|\.)\x20?[A-Za-z]{2,20}){1,4}"),
        (False, r"\x20dot\x20", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20at\x20[A-Za-z0-9-]{2,63}+\x20dot\x20[A-Za-z]{2,20}"),
        (False, r"@[A-Za-z0-9-]++(?!\.)", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?![A-Za-z0-9.-])"),
    ],
    "ip": [(False, r":[0-9A-Fa-f]{0,4}:", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:|::?(?=[0-9A-Fa-f])){1,7}(?::?[0-9A-Fa-f]{1,4}|:)(?![0-9A-Za-z:])")],
    "card": [(False, r"[0-9]{4}[\x20-]?[0-9]", r"(?<![0-9.,+-])[0-9]{4}(?:[\x20-]?[0-9]){8,15}(?![0-9])")],
    "phone": [
        (True, r"[0-9]\)", r"(?<![0-9A-Za-z+.-])\([0-9]{2,5}\)\x20?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])"),
        (False, r"[0-9]{2}[\x20./-][0-9]{2}", r"(?<![0-9A-Za-z+.,:/-])[0-9]{2,5}(?:[\x20./-][0-9]{2,5}){1,4}(?![0-9])"),
        (False, r"0[0-9]{8}", r"(?<![0-9A-Za-z+.,:/-])0[0-9]{8,14}(?![0-9])"),
    ],
    "iban": [(False, r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")],
    "secret": [(False, r"[A-Za-z_-][0-9]|[0-9][A-Za-z_-]", r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]{0,200}[0-9])[A-Za-z0-9_-]{16,}+")],
}
AROUND = 40
#: Words before a span that speak for a kind, and words that speak against any.
CUES = {
    "email": r"(?i)(mail|contact|write|reach|from|to)\W*$",
    "ip": r"(?i)(\bip|ipv6|addr\w*|host|server|client|login\w*|from)\W*$",
    "card": r"(?i)(card|visa|mastercard|amex|credit|debit|pay\w*)\W*(no\W*|number\W*)?$",
    "phone": r"(?i)(phone|tel|call|mobile|cell|fax|whatsapp)\W*(me\W*|us\W*|at\W*|on\W*|no\W*|number\W*)?$",
    "iban": r"(?i)(iban|account|konto|bank|transfer)\W*(no\W*|number\W*)?$",
    "secret": r"(?i)(token|secret|passw\w*|key|bearer|credential\w*|auth\w*)\W*(is\W*)?$",
}
COUNTER_CUES = r"(?i)(isbn|issn|doi|version|release|order|invoice|article|page|pp|fig\w*|table|chapter|section|ticket|issue|item|model|serial|build|sha\w*|md5|commit|date|time|since|until|year|number of|price|[$\x{20AC}\x{A3}#])\W*$"
#: Common endings of domains, countries of bank accounts, and what issued keys begin with (fixed values).
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "co", "de", "fr", "es", "it", "uk", "nl", "ch", "at", "eu", "us", "ca", "jp", "cn", "in", "br", "ru", "example", "test")
COUNTRIES = ("AD", "AE", "AT", "BE", "BG", "CH", "CY", "CZ", "DE", "DK", "EE", "ES", "FI", "FR", "GB", "GR", "HR", "HU", "IE", "IS", "IT", "LI", "LT", "LU", "LV", "MC", "MT", "NL", "NO", "PL", "PT", "RO", "SE", "SI", "SK", "SM", "TR")
KEY_PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "sk_test_", "pk_live_", "eyJ")
_SPANS = "array<struct<kind:string,s:int,e:int,base:boolean,l_regex:int,l_check:int,l_gazetteer:int,l_context:int,l_edges:int,l_variety:int,digits:int>>"
LABELERS = ["l_regex", "l_check", "l_gazetteer", "l_context", "l_edges", "l_variety"]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def value(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), lambda acc, i: acc + F.coalesce(value(i), F.lit(0))) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.lpad(F.regexp_replace(p, "^0+", ""), 3, "0") <= "255"))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(_digits(m))).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def _by_kind(kind: Column, values: dict[str, Column]) -> Column:
    """The value of the kind; null for other kinds."""
    (first, value), *rest = values.items()
    out = F.when(kind == first, value)
    for k, v in rest:
        out = out.when(kind == k, v)
    return out


def _hits(text: Column, kind: str, pattern: str, needs: str, base: bool, plain: bool = False) -> Column:
    """Leftmost non-overlapping matches and the lengths of what lies between them; null where ``needs`` isn't found."""
    gaps, hits = F.transform(F.split(text, pattern, -1), F.length), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    labels = F.lit(kind).alias("kind"), F.lit(base).alias("base"), F.lit(1 if base or plain else 0).alias("l_regex")
    return F.when(text.rlike(needs), F.struct(*labels, gaps.alias("gaps"), hits.alias("hits")))


def _matches(x: Column) -> Column:
    """The matches of ``_hits`` one by one; offsets in code points from the lengths of what lies between."""
    n = F.size(x["hits"])
    sizes = F.zip_with(F.slice(x["gaps"], 1, n), x["hits"], lambda g, h: g + F.length(h))

    def match(h: Column, e: Column) -> Column:
        return F.struct(x["kind"].alias("kind"), x["base"].alias("base"), x["l_regex"].alias("l_regex"), (e - F.length(h)).alias("s"), e.alias("e"), h.alias("m"))

    return F.zip_with(x["hits"], running(sizes, n, plus), match)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _rest97(m: Column) -> Column:
    """The account number, its first four characters moved to the end and letters read as 10 to 35, modulo 97."""
    bare = F.regexp_replace(m, r"\x20", "")
    turned = F.split(F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4)), "")

    def step(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (acc * 10 + F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0))) % 97).when(c == "", acc).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(turned, F.lit(0), step)


def _seen(x: Column, of: Column) -> Column:
    """The match with its digits and what stands before and after it; ``of``: chunks of the text."""
    before, after = between(of, F.greatest(x["s"] - AROUND, F.lit(0)), x["s"]), between(of, x["e"], x["e"] + 1)
    same = (x[c].alias(c) for c in ("kind", "base", "l_regex", "s", "e", "m"))
    return F.struct(*same, _digits(x["m"]).alias("digits"), before.alias("before"), after.alias("after"))


def _votes(kind: str, m: Column, digits: Column) -> tuple[Column, Column, Column]:
    """The votes that depend on the kind: check, gazetteer and variety."""
    n, never = F.length(digits), F.lit(False)
    if kind == "email":
        domain = F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1))
        check, gazetteer = _vote(m.rlike(r"\.[A-Za-z]|dot") & (F.length(m) <= 254), never), _vote(domain.isin(*DOMAINS), domain.rlike("^[0-9]+$|.{12}"))
        varied = F.lit(0)
    elif kind == "ip":
        quad, groups = m.rlike(r"\."), F.size(F.split(m, ":"))
        short = m.rlike("::")
        check = F.when(quad, 1).otherwise(_vote((short & (groups <= 8) & ~m.rlike("::.*::|:::")) | (~short & (groups == 8)), ~short | m.rlike("::.*::|:::")))
        gazetteer = F.when(quad, _vote(m.rlike(r"^(10|127|192\.168|[1-9][0-9]?|1[0-9]{2}|2[01][0-9]|22[0-3])\."), m.rlike(r"^0+\.|^(22[4-9]|23[0-9]|24[0-9]|25[0-5])\."))).otherwise(_vote(m.rlike("(?i)^(2[0-9a-f]{3}|3[0-9a-f]{3}|f[cd][0-9a-f]{2}|fe80):"), ~m.rlike("[0-9A-Fa-f]{3}")))
        varied = _vote(never, m.rlike(r"^0+\.0+\.0+\.0+$"))
    elif kind == "card":
        check = _vote(luhn(digits) & n.between(13, 19), ~luhn(digits))
        gazetteer = _vote(digits.rlike("^(4|5[1-5]|2[2-7]|3[47]|6)"), digits.rlike("^[0178]"))
        varied = _vote(never, digits.rlike(r"^(.)\1*$"))
    elif kind == "phone":
        dated = m.rlike(r"^(1[89]|20)[0-9]{2}[./-][01]?[0-9][./-][0-3]?[0-9]$|^[0-3]?[0-9][./-][0-3]?[0-9][./-]([0-9]{2})?[0-9]{2}$|^(1[89]|20)[0-9]{2}[/-](1[89]|20)?[0-9]{2}$")
        written = m.rlike(r"^[+(0]|^[2-9][0-9]{2}[.-][0-9]{3}[.-][0-9]{4}$")
        check = _vote(n.between(8, 15) & ~dated & written, ~n.between(8, 15) | dated)
        gazetteer = _vote(m.rlike(r"^\+(1|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-8])|^00[1-9]|^0[1-9]"), m.rlike(r"^\(?000"))
        varied = _vote(never, digits.rlike(r"^(.)\1*$"))
    elif kind == "iban":
        check, gazetteer, varied = _vote(_rest97(m) == 1, _rest97(m) != 1), _vote(F.substring(m, 1, 2).isin(*COUNTRIES), ~F.substring(m, 1, 2).isin(*COUNTRIES)), F.lit(0)
    else:
        letters = F.length(F.regexp_replace(m, "[^A-Za-z]", ""))
        check = _vote((n >= 4) & (letters >= 4) & (F.length(m) >= 20), (n < 3) | (letters < 2))
        gazetteer = _vote(F.exists(F.array(*map(F.lit, KEY_PREFIXES)), lambda p: F.startswith(m, p)), m.rlike("[-_][A-Za-z]*[-_]"))
        varied = _vote(F.size(F.array_distinct(F.split(m, ""))) >= 12, F.size(F.array_distinct(F.split(m, ""))) < 8)
    return check, gazetteer, varied


def _labels(x: Column) -> Column:
    """The candidate with its votes."""
    before, after, kind = x["before"], x["after"], x["kind"]
    votes = {k: _votes(k, x["m"], x["digits"]) for k in ALL_KINDS}
    check, gazetteer, varied = (_by_kind(kind, {k: v[i] for k, v in votes.items()}) for i in range(3))
    touch = before.rlike(r"[\p{L}\p{N}_=/#.-]$") | after.rlike(r"^[\p{L}\p{N}_=/#-]")
    cue = _by_kind(kind, {k: before.rlike(CUES[k]) for k in ALL_KINDS})
    return F.struct(
        kind.alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["base"].alias("base"), x["l_regex"].alias("l_regex"), check.alias("l_check"), gazetteer.alias("l_gazetteer"),
        _vote(cue, before.rlike(COUNTER_CUES)).alias("l_context"), _vote(F.lit(False), touch).alias("l_edges"), varied.alias("l_variety"), F.least(F.length(x["digits"]), F.lit(20)).alias("digits"),
    )


def candidates(text: Column) -> Column:
    """All candidates of a text, by kind and form.

    The forms' matches are put into one array first, so that spans, surroundings and votes are written once in the plan and not
    once a form: the driver builds, analyses and keeps the plan.
    """
    text = F.coalesce(text, F.lit(""))
    base = [_hits(text, k, BASE[k], NEEDS[k], True) for k in KINDS]
    loose = [_hits(text, k, form, needs, False, plain) for k in ALL_KINDS for plain, needs, form in LOOSE[k]]
    found = F.flatten(F.transform(F.array_compact(F.array(*base, *loose)), _matches))
    checked = F.filter(found, lambda x: ~x["base"] | _by_kind(x["kind"], {k: _valid(k, x["m"]) for k in KINDS}))
    return let(chunks(text), lambda of: F.transform(F.transform(checked, lambda x: _seen(x, of)), _labels))


def with_candidates(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with a column ``_spans`` of candidates of ``text``, null where it shows no sign of any."""
    looks = F.coalesce(text, F.lit("")).rlike(r"[0-9@]|[(\[]at[)\]]|\x20dot\x20|:[A-Fa-f:]")

    return docs.withColumn("_spans", _clear(F.when(looks, candidates(text)), False))


def _clear(spans: Column, loose: bool) -> Column:
    """Spans by start, without those that overlap a base span and, if ``loose``, an earlier or longer one of the others."""
    order = lambda c: F.struct(c["s"], ~c["base"], -c["e"], F.array_position(F.array(*map(F.lit, ALL_KINDS)), c["kind"]))
    placed = F.transform(F.array_sort(F.transform(spans, lambda c: F.struct(order(c).alias("at"), c.alias("c")))), lambda x: x["c"])
    far = F.lit(2**31 - 1)

    def clear_of_base(p: Column) -> Column:
        ends = running(F.transform(p, lambda c: F.when(c["base"], c["e"]).otherwise(0)), F.size(p), F.greatest)
        starts = F.reverse(running(F.reverse(F.transform(p, lambda c: F.when(c["base"], c["s"]).otherwise(far))), F.size(p), F.least))
        near = F.arrays_zip(p.alias("c"), ends.alias("end"), starts.alias("start"))
        return F.transform(F.filter(near, lambda x: x["c"]["base"] | ((x["end"] <= x["c"]["s"]) & (x["start"] >= x["c"]["e"]))), lambda x: x["c"])

    kept = let(placed, clear_of_base)
    if not loose:
        return kept
    taken = lambda end, c: c["base"] | (c["s"] >= end)
    return chosen(kept, F.lit(0), taken, lambda end, c: F.when(taken(end, c), F.greatest(end, c["e"])).otherwise(end), _SPANS)


class SpanModel:
    """Labeler reliabilities and the classifier's coefficients."""

    def __init__(self, labelers: VoteModel, weights: list[float], intercept: float):
        self.labelers, self.weights, self.intercept = labelers, weights, intercept

    def accepts(self, c: Column) -> Column:
        """Whether the classifier takes the span; where all labelers abstain or are against there is nothing to go by."""
        z = F.lit(self.intercept)
        for w, x in zip(self.weights, _features(c), strict=True):
            z = z + x * F.lit(w)
        return (z >= 0) & (F.greatest(*(c[v] for v in LABELERS)) > 0)


def _features(c: Column) -> list[Column]:
    kinds = [(c["kind"] == k).cast("double") for k in ALL_KINDS[1:]]
    return [*(c[v].cast("double") for v in LABELERS), *kinds, c["digits"].cast("double") / 20]


def learn(spans: DataFrame) -> SpanModel:
    """``spans``: documents with ``_spans``. Without candidates the model accepts none."""
    names = ["kind", "digits", *LABELERS]
    flat = spans.where(F.size("_spans") > 0).select(F.explode("_spans").alias("c")).select(*(F.col("c")[n].alias(n) for n in names))
    counted = cut(flat.groupBy(*names).agg(F.count("*").cast("double").alias("n")))  # bounded by kinds, digit counts and 3 ** labelers
    rows = counted.groupBy(*LABELERS).agg(F.sum("n").alias("n")).collect()
    reliab = fit(sorted((tuple(int(r[c]) for c in LABELERS), r["n"]) for r in rows), LABELERS, start=lambda votes: 1 / (1 + exp(1.5 * (0.75 - sum(votes)))))
    if not rows:
        return SpanModel(reliab, [0.0] * (len(LABELERS) + len(ALL_KINDS)), -1.0)
    soft = counted.withColumn("p", reliab.column())
    both = soft.withColumn("y", F.explode(F.array(F.lit(0.0), F.lit(1.0)))).withColumn("w", F.col("n") * F.when(F.col("y") > 0, F.col("p")).otherwise(1 - F.col("p")) + 1e-6)
    whole = F.struct(*(F.col(n) for n in names))
    train = both.withColumn("c", whole).select(array_to_vector(F.array(*_features(F.col("c")))).alias("x"), "y", "w")
    fitted = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=1e-3, maxIter=50).fit(train)
    return SpanModel(reliab, [float(v) for v in fitted.coefficients], float(fitted.intercept))


def _listed(spans: Column) -> Column:
    """kind:start:end, by kind as listed, then start."""
    place = lambda c: F.array_position(F.array(*map(F.lit, ALL_KINDS)), c["kind"]).cast("int")
    ordered = F.array_sort(F.transform(spans, lambda c: F.struct(place(c).alias("k"), c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda c: F.concat_ws(":", c["kind"], c["s"].cast("string"), c["e"].cast("string"))), ",")


def _chosen(model: SpanModel) -> Column:
    """The spans that stay: null where there are no candidates."""
    return _clear(F.filter("_spans", lambda c: c["base"] | model.accepts(c)), True)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of ``docs``.

    Counts and digest are of the base spans, ``spans`` lists base and added ones; offsets are code points, end exclusive.
    A null or empty text has no spans, "" listed and the digest of "". Repeated rows and null ids stay as rows; an empty
    table gives none. Only doc_id and text are read; whole texts are searched.
    """
    found = cut(with_candidates(docs.select("doc_id", "text"), F.col("text")).select("doc_id", "_spans"))
    model = learn(found)
    base = F.filter("_spans", lambda c: c["base"])

    def count(kind: str) -> Column:
        n = F.size(F.filter("_spans", lambda c: c["base"] & (c["kind"] == kind)))
        return F.when(F.col("_spans").isNull(), 0).otherwise(n).cast("long").alias(f"n_{kind}")

    digest = F.sha2(F.coalesce(_listed(base), F.lit("")), 256)
    return found.select("doc_id", *map(count, KINDS), digest.alias("base_sha256"), F.coalesce(_listed(_chosen(model)), F.lit("")).alias("spans"))


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with each found span replaced by <KIND>; overlapping spans are masked as one. n_chars follows the new text.

    Rows are written once with their candidates, so texts are searched once. Null and empty texts and those without spans
    stay as they are, as do null ids, repeated rows and all other columns, of any name; texts may be of any length; an empty
    table gives none.
    """
    found = stored(with_candidates(docs.select(packed(docs)), F.col("row.text")))
    ordered = F.array_sort(F.transform(_chosen(learn(found)), lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind"))))
    text = F.col("row.text")

    def masked(x: Column) -> Column:
        def piece(c: Column, i: Column) -> Column:
            at = F.when(i > 0, F.get(x["ends"], i - 1)).otherwise(0)
            return F.concat(between(x["of"], at, c["s"]), F.when(c["s"] >= at, F.concat(F.lit("<"), F.upper(c["kind"]), F.lit(">"))).otherwise(""))

        return F.concat(F.array_join(F.transform(x["spans"], piece), ""), between(x["of"], F.element_at(x["ends"], -1), F.length(text)))

    some = F.size("_chosen") > 0
    ends = running(F.transform("_chosen", lambda c: c["e"]), F.size("_chosen"), F.greatest)
    out = found.withColumn("_chosen", ordered)
    out = out.withColumn("_new", F.when(some, let(F.struct(F.col("_chosen").alias("spans"), ends.alias("ends"), chunks(text).alias("of")), masked)).otherwise(text))
    changed = {"text": F.col("_new")} | ({"n_chars": F.when(some, F.length("_new").cast("long")).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {})
    return out.select(*unpacked(docs, **changed))
