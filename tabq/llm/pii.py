"""Personal data by weak supervision, in DataFrame expressions.

Candidate spans come from patterns. Four labelers vote on each (pattern validity, a gazetteer, context words, shape)
or abstain. Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is; its
posteriors train a logistic span classifier, which decides on the candidates beyond the strict patterns: those are taken,
the likeliest first, as long as their mean probability keeps to the wanted precision. Strict spans always stay. The driver
sees only the counts of vote patterns, of which there are at most 4 * 3**4 * 3. Work is linear in the spans of a text.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

KINDS = ("email", "ip", "card", "phone")
#: Candidates beyond the strict patterns become spans while their estimated precision, by kind, is so high, and each is so likely.
PRECISION, LEAST = 0.9, 0.5
# The strict patterns. Possessive runs and look-behinds only spare the matcher work; the spans are the same.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Candidates that the strict patterns miss: spelled-out and spaced addresses, bracketed dots, other separators, numbers
# without a country code or with 00, and well-formed numbers inside a run of digits that fails as a whole.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]{2,64} ?(?:\[at\]|\(at\)|\{at\}|(?<= )@(?= )) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\[dot\]|\(dot\)|\{dot\}) ?[A-Za-z0-9-]{1,63}){1,4}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\])[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9./_-])(?:[0-9]{4}(?:[./_ -][0-9]{4}){3}|[0-9]{13,19})(?![0-9./_-])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:(?:\+|00)[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-.][0-9]{4}(?![0-9A-Za-z-])",
}
_NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_NEEDS_LOOSE = {"email": r"[\[({]at[\])}]| @ ", "ip": r"[0-9][\[(]", "card": r"[0-9]{4}[./_ -]?[0-9]{4}", "phone": r"[0-9]{3}[-.][0-9]{4}"}
# Gazetteers and context words.
TOP_DOMAINS = "com org net edu gov mil int info biz io co eu de fr es it nl uk us ca au ch at be se no dk pl pt br mx jp cn in ru example".split()
CARD_PREFIX = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30[0-5]|36|38)"
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|mailto|contact|correo|courriel|kontakt|adresse|write to)\b",
    "ip": r"(?i)\b(?:ip|ipv4|host|server|address|adresse|gateway|dns)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|karte|carte|tarjeta|credit|payment)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|telefon|tel[eé]fono|t[eé]l[eé]phone|whatsapp|handy)\b",
}
COUNTER = r"(?i)\b(?:isbn|issn|order|invoice|version|build|part|item|page|ticket|serial|doi)\b"
BEFORE = 28
_SPANS = "array<struct<start:int,end:int,m:string,before:string,edges:string>>"
#: Running sums and the like are worked out in pieces of so many elements, since an array grows by copying it.
_PIECE = 128


def _let(value: Column, body) -> Column:
    """`body` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, zero: int, op) -> Column:
    """The running sums (or whatever `op` does, with its neutral element) of an array of ints."""
    none = F.array().cast("array<int>")
    last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(zero))
    scan = lambda x: F.aggregate(x, none, lambda acc, y: F.concat(acc, F.array(op(last(acc), y))))

    def whole(parts: Column) -> Column:
        before = F.aggregate(parts, F.array(F.lit(zero)), lambda acc, x: F.concat(acc, F.array(op(last(acc), last(x)))))
        return F.flatten(F.zip_with(parts, F.slice(before, F.lit(1), F.size(parts)), lambda x, b: F.transform(x, lambda y: op(b, y))))

    pieces = lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(x) - 1) / F.lit(_PIECE)).cast("int"))), lambda k: scan(F.slice(x, k * _PIECE + 1, F.lit(_PIECE))))
    return _let(values, lambda x: _let(pieces(x), whole))


def _spans(text: Column, pattern: str, needs: str) -> Column:
    """Leftmost non-overlapping matches with their code-point positions: the pieces between matches give the starts, and what stands around."""

    def found(x: Column) -> Column:
        n = F.size(x["m"])
        sizes = F.zip_with(F.slice(x["gaps"], F.lit(1), n), x["m"], lambda gap, m: F.length(gap) + F.length(m))
        rows = F.arrays_zip(x["m"].alias("m"), F.slice(x["gaps"], F.lit(1), n).alias("gap"), F.slice(x["gaps"], F.lit(2), n).alias("next"), _running(sizes, 0, lambda a, b: a + b).alias("end"))

        def span(r: Column, i: Column) -> Column:
            m, gap, after, end = (r.getField(k) for k in ("m", "gap", "next", "end"))
            # a match right behind another has a letter before it, so to speak
            edges = F.concat(F.lit(" "), F.when((F.length(gap) == 0) & (i > 0), "x").otherwise(F.substring(gap, -1, 1)), F.lit("|"), F.substring(after, 1, 1))
            return F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("m"), F.substring(gap, -BEFORE, BEFORE).alias("before"), edges.alias("edges"))

        return F.transform(rows, span)

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(text.rlike(needs), _let(both, found)).otherwise(F.array().cast(_SPANS))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))
    value = lambda i: F.substring(d, i, F.lit(1)).cast("int")
    double = lambda v: v * 2 - F.when(v > 4, 9).otherwise(0)
    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, double(value(i))).otherwise(value(i)))
    return F.length(d).between(12, 19) & (total % 10 == 0)


def _octets(m: Column) -> Column:
    bare = lambda p: F.ltrim(p, F.lit("0"))
    return F.forall(F.split(m, "[^0-9]+"), lambda p: (F.length(bare(p)) <= 3) & (F.coalesce(F.try_to_number(F.concat(F.lit("0"), F.substring(bare(p), 1, 3)), F.lit("9999")).cast("int"), F.lit(0)) <= 255))


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return _octets(m)
    if kind == "card":
        # the sum is only worked out for 12 to 19 digits
        return F.when(F.length(_digits(m)).between(12, 19), _luhn(m)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _gazetteer(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1)).isin(TOP_DOMAINS)
    if kind == "ip":
        return F.regexp_extract(m, r"^0*([0-9]+)", 1).rlike(r"^(?:[1-9][0-9]?|1[0-9]{2}|2[01][0-9]|22[0-3])$")
    if kind == "card":
        return _digits(m).rlike(CARD_PREFIX)
    return F.when(m.rlike(r"^(?:\+|00)"), m.rlike(r"^(?:\+|00)[1-9]")).otherwise(_digits(m).rlike(r"^[2-9][0-8][0-9][2-9]"))


def _with_votes(spans: Column, kind: str, strict: bool) -> Column:
    """Spans with votes (1 yes, 0 no, 2 abstains) by validity, gazetteer, context and shape, and a length class."""

    def votes(x: Column) -> Column:
        ok = _valid(kind, x["m"])
        regex = F.when(ok, 1).otherwise(0) if strict else F.when(ok, 2).otherwise(0)
        context = F.when(x["before"].rlike(CONTEXT[kind]), 1).when(x["before"].rlike(COUNTER), 0).otherwise(2)
        shape = F.when(x["edges"].rlike(r"[A-Za-z0-9]"), 0).otherwise(1)
        size = F.when(x["end"] - x["start"] < 12, 0).when(x["end"] - x["start"] < 18, 1).otherwise(2)
        fields = {"start": x["start"], "end": x["end"], "strict": F.lit(strict), "ok": ok, "v0": regex, "v1": F.when(_gazetteer(kind, x["m"]), 1).otherwise(0), "v2": context, "v3": shape, "size": size}
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), *[v.alias(k) for k, v in fields.items()])

    return F.transform(spans, votes)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and the array of candidate spans with their votes, for each row."""
    t = F.col("text")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = [_with_votes(_spans(t, STRICT[k], _NEEDS[k]), k, True) for k in KINDS] + [_with_votes(_spans(t, LOOSE[k], _NEEDS_LOOSE[k]), k, False) for k in KINDS]
    return rows.select("doc_id", F.concat(*parts).alias("spans"))


N_LABELERS = 4


def estimate(counts: dict[tuple, int], rounds: int = 60) -> dict[tuple, float]:
    """Posterior of each vote pattern (kind, votes...): labelers independent given the truth, reliabilities by kind from EM."""
    out = {}
    for kind in range(len(KINDS)):
        rows = [(k[1 : 1 + N_LABELERS], n) for k, n in counts.items() if k[0] == kind]
        if not rows:
            continue
        post = []
        for votes, _ in rows:  # starts from the majority
            yes, no = sum(v == 1 for v in votes), sum(v == 0 for v in votes)
            post.append(min(0.95, max(0.05, (yes + 0.5) / (yes + no + 1.0))))
        for _ in range(rounds):
            total = sum(n for _, n in rows)
            prior = (sum(p * n for p, (_, n) in zip(post, rows)) + 1) / (total + 2)
            tables = []
            for j in range(N_LABELERS):
                # pseudo-counts say that labelers are right more often than wrong
                t = [[2.0, 1.0, 1.0], [1.0, 2.0, 1.0]]
                for p, (votes, n) in zip(post, rows):
                    t[1][votes[j]] += p * n
                    t[0][votes[j]] += (1 - p) * n
                tables.append([[x / sum(r) for x in r] for r in t])
            new = []
            for votes, _ in rows:
                a = math.log(prior) + sum(math.log(tables[j][1][v]) for j, v in enumerate(votes))
                b = math.log(1 - prior) + sum(math.log(tables[j][0][v]) for j, v in enumerate(votes))
                new.append(1 / (1 + math.exp(min(60.0, max(-60.0, b - a)))))
            post = new
        out.update({(kind, *votes): p for (votes, _), p in zip(rows, post)})
    return out


def _one_hot(key: tuple) -> list[float]:
    """Features of a span: kind, each labeler's yes and no, length class, and a constant."""
    kind, votes, size = key[0], key[1 : 1 + N_LABELERS], key[-1]
    return [1.0, *[float(kind == k) for k in range(len(KINDS))], *[float(v == a) for v in votes for a in (0, 1)], *[float(size == k) for k in range(3)]]


def train_classifier(counts: dict[tuple, int], posterior: dict[tuple, float]) -> np.ndarray:
    """Logistic weights fitted to the posteriors of the counted patterns (kind, votes, length class)."""
    keys = sorted(counts)
    if not keys:
        return np.zeros(len(_one_hot((0, 0, 0, 0, 0, 0))))
    x = np.array([_one_hot(k) for k in keys])
    y = np.array([posterior[k[: 1 + N_LABELERS]] for k in keys])
    n = np.array([math.sqrt(counts[k]) for k in keys])
    n, w = n / n.sum(), np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w)), x.T @ (n * (p - y)) + 1e-3 * w)
    return w


def probability(key: tuple, w: np.ndarray) -> float:
    return float(1 / (1 + np.exp(-np.clip(np.array(_one_hot(key)) @ w, -30, 30))))


def levels(counts: dict[tuple, int], w: np.ndarray) -> list[float]:
    """For each kind the least probability of a loose candidate that is taken; 2 if none is."""
    out = []
    for kind in range(len(KINDS)):
        total, sure, level = 0, 0.0, 2.0
        # loose candidates are those on whose pattern the first labeler abstains
        for p, n in sorted(((probability(k, w), n) for k, n in counts.items() if k[0] == kind and k[1] == 2), reverse=True):
            total, sure = total + n, sure + n * p
            if p >= LEAST and sure >= PRECISION * total:
                level = p
        out.append(level)
    return out


def _taken(x: Column, counts: dict[tuple, int], w: np.ndarray, least: list[float]) -> Column:
    """Whether the classifier takes a loose candidate: a table of the vote patterns that were counted."""
    yes = ["/".join(map(str, k)) for k in sorted(counts) if k[1] == 2 and probability(k, w) >= least[k[0]]]
    return F.concat_ws("/", x["kind"], *[x[f"v{j}"] for j in range(N_LABELERS)], x["size"]).isin(yes)


def _apart(base: Column, loose: Column) -> Column:
    """Strict spans and the loose ones that overlap none of them, by start."""
    far = (1 << 31) - 1
    spans = lambda xs, rank: F.transform(xs, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("loose"), x["end"].alias("end"), x["kind"].alias("kind")))

    def kept(xs: Column) -> Column:
        reached = _running(F.transform(xs, lambda x: F.when(x["loose"] == 0, x["end"]).otherwise(0)), 0, F.greatest)
        coming = F.reverse(_running(F.reverse(F.transform(xs, lambda x: F.when(x["loose"] == 0, x["start"]).otherwise(far))), far, F.least))
        rows = F.arrays_zip(xs.alias("x"), reached.alias("reached"), coming.alias("coming"))
        free = F.filter(rows, lambda r: (r.getField("x")["loose"] == 0) | (r.getField("reached") <= r.getField("x")["start"]) & (r.getField("coming") >= r.getField("x")["end"]))
        return F.transform(free, lambda r: r.getField("x"))

    return _let(F.sort_array(F.concat(spans(base, 0), spans(loose, 1))), kept)


def _joined(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for each row.

    Counts and base_sha256 are of the strict spans; `spans` also has the accepted loose ones, none of which overlaps a
    strict span or an earlier loose one of its kind. Labelers see what stands between a span and the one of its kind before
    it. Null texts count as empty and have no span. Equal texts give equal
    rows. Other columns are not read; an empty table gives no rows.
    """
    rows = checkpointed(candidates(docs))
    votes = rows.select(F.explode("spans").alias("x")).select("x.kind", "x.v0", "x.v1", "x.v2", "x.v3", "x.size")
    counted = votes.groupBy(*votes.columns).count().collect()  # at most 4 * 3**4 * 3 rows
    counts = {tuple(r[:-1]): r[-1] for r in counted}
    pooled: dict[tuple, int] = {}
    for k, n in counts.items():
        pooled[k[: 1 + N_LABELERS]] = pooled.get(k[: 1 + N_LABELERS], 0) + n
    w = train_classifier(counts, estimate(pooled))
    least = levels(counts, w)
    rows = rows.withColumn("base", F.filter("spans", lambda x: x["strict"] & x["ok"]))
    loose = F.filter("spans", lambda x: ~x["strict"] & (x["v0"] == 2) & _taken(x, counts, w, least))
    rows = rows.withColumn("all", _apart(F.col("base"), loose))
    of_kind = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    n = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    added = (F.size("all") - F.size("base")).cast("long").alias("n_added")
    return rows.select("doc_id", *n, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"), added)


def op4_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
