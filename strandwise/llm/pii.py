"""Personal data in texts: fixed patterns, and weak supervision that adds spans in other forms.

Everything that touches rows is a DataFrame or SQL function. Labelers (patterns, checksums, gazetteers, contexts) vote
on every candidate span, expectation-maximisation estimates how far each can be trusted, and a classifier of the
span's own looks is trained on the resulting beliefs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.session import durable

#: Kinds of spans, in their order: four fixed patterns, then the forms that the classifier may add.
BASE = ("email", "ip", "card", "phone")
LOOSE = ("mail", "number", "iban", "name")
KINDS = BASE + LOOSE
#: Families share labelers and a classifier. A base ip has no other form, so it belongs to none.
FAMILIES = ("mail", "number", "name")
FAMILY = {"email": 0, "mail": 0, "card": 1, "phone": 1, "number": 1, "iban": 1, "name": 2}

#: The fixed patterns. Possessive runs, begun only where a run begins or the last match ended, find the same
#: matches as plain ones without reading a long run again from each of its characters.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
GIVEN_NAMES = "Alice Ana Andrea Anna Antonio Barbara Carlos Carmen Charles Charlotte Claire David Elena Elizabeth Emily Emma Francisco Frank George Hans Isabel James Jean Jennifer Jessica Johann John Jorge Joseph Juan Julia Karl Klaus Laura Linda Louis Lucia Manuel Maria Marie Mark Martin Mary Michael Miguel Monika Nicole Olivia Patricia Paul Pedro Peter Petra Philippe Pierre Richard Robert Sabine Sarah Sofia Stefan Susan Thomas Ursula William Wolfgang"
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Mme Sr Sra"
DOMAINS = "com org net edu gov int info biz io eu uk us de fr es it nl ch at be pt pl ca au jp"
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 380 420 421"
COUNTRIES = "AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK"


def any_of(words: str) -> str:
    return "|".join(words.split())


#: Other forms, to be judged. Their runs are bounded, so no start reads far.
AT, DOT = r"(?: ?[\[({<] ?(?:at|AT|@) ?[\])}>] ?| (?:at|AT) | @ )", r"(?: ?[\[({<] ?(?:dot|DOT|\.) ?[\])}>] ?| (?:dot|DOT) |\.)"
PATTERNS |= {
    "mail": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{AT}[A-Za-z0-9-]{{1,63}}+(?:{DOT}[A-Za-z0-9-]{{1,63}}+){{1,5}}+",
    "number": r"(?<![\p{L}\p{N}_.,+/=@-])\(?[0-9](?:[ ().\-/]{0,2}[0-9]){6,24}+(?![\p{L}\p{N}_@])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3}+)?+(?![A-Za-z0-9])",
    "name": rf"(?<!\p{{L}})(?:(?:{any_of(TITLES)})\.? \p{{Lu}}\p{{Ll}}++(?: \p{{Lu}}\p{{Ll}}++)?+|(?:{any_of(GIVEN_NAMES)}) \p{{Lu}}\p{{Ll}}++)",
}
#: What a text must hold before a pattern is tried.
NEEDS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][ -]?[0-9]"),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "mail": lambda t: t.rlike(r"[Aa@][Tt)\]}> ]"),
    "number": lambda t: t.rlike(r"[0-9]"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"),
    "name": lambda t: F.lit(True),
}
LEFT, RIGHT = 40, 12

#: Words before a span that speak for it or against it, by family.
CUES = {
    "mail": r"(?i)(?:e-?mail|mail|contact|write|reach|courriel|correo|adresse|schreib\w*|escrib\w*)\W*(?:\w+\W+)?$",
    "number": r"(?i)(?:tel|telefon|téléphone|teléfono|phone|call|mobile|fax|cell|whatsapp|card|carte|karte|tarjeta|visa|mastercard|ssn|social security|iban|account|konto|compte|cuenta|contact|anruf\w*|appelez|llam\w+)\W*(?:\w+\W+)?$",
    "name": r"(?i)(?:name is|named|signed|regards|sincerely|dear|by|author|contact|patient|nom|nombre|heiße?|von|par)\W*$",
}
AGAINST = {
    "mail": r"(?i)(?:look|looks|looked|arrive\w*|only|not|be|is|was|all)\W*$",
    "number": r"(?i)(?:version|page|pages|isbn|issn|doi|order|item|total|sum|price|year|token|key|hash|id|serial|build|[$€£=])\W*$",
    "name": r"(?i)(?:street|avenue|rue|calle|saint|san|santa|king|queen|lake|mount|university|hotel)\W*$",
}


@dataclass
class Labeler:
    """A vote on a span: 1 for, -1 against, 0 none. ``span`` has the columns kind, hit, left and right."""

    name: str
    vote: Column


def _vote(yes: Column, no: Column | None = None) -> Column:
    chosen = F.when(yes, 1)
    return (chosen if no is None else chosen.when(no, -1)).otherwise(0)


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of up to 19 digits is right. Null for other lengths."""
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return total + F.when((n - i) % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.when(n.between(12, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0)


def remainder_97(hit: Column) -> Column:
    """The remainder of an account number's first four characters moved to its end, letters as 10 to 35."""
    plain = F.regexp_replace(hit, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    value = lambda c: F.ascii(c) - F.when(c >= "A", 55).otherwise(48)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(F.length(c) == 0, a).otherwise((a * F.when(c >= "A", 100).otherwise(10) + value(c)) % 97))


def labelers(family: str) -> list[Labeler]:
    """The labelers of a family. Each looks at one thing: the pattern, the shape, a check digit, a list, a context."""
    hit, left, right = F.col("hit"), F.col("left"), F.col("right")
    base = F.col("kind").isin(*[KINDS.index(k) for k in BASE])
    shared = [Labeler("pattern", _vote(base)), Labeler("context", _vote(left.rlike(CUES[family]), left.rlike(AGAINST[family])))]
    if family == "mail":
        last = F.lower(F.regexp_extract(F.right(hit, F.lit(64)), r"([A-Za-z0-9-]+)$", 1))
        user = F.regexp_extract(hit, r"^([A-Za-z0-9._%+-]+)", 1)
        return shared + [
            Labeler("mark", _vote(hit.rlike(r"(?i)@|[\[({<] ?at"), ~hit.rlike(r"(?i)dot"))),
            Labeler("domain", _vote(last.isin(*DOMAINS.split()), F.lit(True))),
            Labeler("stop", _vote(hit.rlike(r"(?i)[\[({<] ?dot| dot |[A-Za-z0-9]@[A-Za-z0-9-]+\.[a-z]"), hit.rlike(r" (?:at|AT) [A-Za-z]+\.[A-Z]"))),
            Labeler("user", _vote(user.rlike(r"[0-9._%+-]|^[a-z]{1,2}[a-z]{3,}$"), F.lower(user).isin("look", "is", "be", "was", "one", "all", "it", "the", "them", "not", "out", "held"))),
        ]
    if family == "number":
        digits = digits_of(hit)
        n = F.length(digits)
        iban = hit.rlike("^[A-Z]{2}")
        forms = r"^(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}(?:[ .-][0-9]{2,4}){1,3}$|^\([0-9]{2,4}\) ?[0-9]{3,4}[ .-][0-9]{3,4}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^[0-9]{4}(?:[ -][0-9]{4}){3}$|^[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4})+"
        other = r"^[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|^[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}|^[0-9]{1,3}(?:[ .][0-9]{3})+$|^[0-9]+[./][0-9]+$|^[0-9]{4} ?[-/] ?[0-9]{4}$"
        calls = r"^(?:\+|00)(?:" + any_of(CALLING) + r")(?:[^0-9]|[0-9]{6,})"
        return shared + [
            Labeler("shape", _vote(hit.rlike(forms) & ~hit.rlike(other), hit.rlike(other))),
            Labeler("check", F.when(iban, _vote(remainder_97(hit) == 1, F.lit(True))).otherwise(_vote(luhn(digits), ~luhn(digits)))),
            Labeler("list", F.when(iban, _vote(F.substring(hit, 1, 2).isin(*COUNTRIES.split()), F.lit(True))).otherwise(_vote(hit.rlike(calls), hit.startswith("+") | hit.startswith("00")))),
            Labeler("edges", _vote(F.lit(False), left.rlike(r"[\p{L}\p{N}$€£%#=\"]$") | right.rlike(r"^(?:[\p{L}\p{N}$€£%\"]|[.,][0-9])"))),
            Labeler("length", _vote(n.between(9, 15) & hit.rlike("[^0-9]"), (n < 9) | hit.rlike("^[0-9]+$") & (n != 16))),
        ]
    first = F.regexp_extract(hit, r"^(?:(?:" + any_of(TITLES) + r")\.? )?(\p{L}+)", 1)
    return shared + [
        Labeler("given", _vote(first.isin(*GIVEN_NAMES.split()))),
        Labeler("title", _vote(hit.rlike(r"^(?:" + any_of(TITLES) + r")\.? "))),
        Labeler("before", _vote(left.rlike(r"[\p{Ll},] $"), left.rlike(r"\p{Lu}\p{L}* $"))),
        Labeler("after", _vote(right.rlike(r"^[,.;)]|^ (?:and|und|et|y|is|said|was|lives)\b"), right.rlike(r"^ \p{Lu}|^ (?:Street|Avenue|University|Hotel)"))),
    ]


def looks(family: str) -> list[Column]:
    """Yes-or-no features of a span that its classifier sees: its looks and surroundings, not who voted how."""
    hit, left, right = F.col("hit"), F.col("left"), F.col("right")
    cue = [left.rlike(CUES[family]), left.rlike(AGAINST[family])]
    if family == "mail":
        return cue + [hit.contains("@"), hit.rlike(r"(?i)[\[({<] ?(?:at|@)"), hit.rlike("(?i) at "), hit.rlike("(?i)dot"), hit.rlike(r"(?i)(?:\.|dot[\])}> ]*)(?:" + any_of(DOMAINS) + ")$"), hit.rlike(r"^[A-Za-z]*[0-9._%+-]"), hit.rlike(r"\.[A-Z]")]
    if family == "number":
        digits = digits_of(hit)
        n = F.length(digits)
        valid = F.coalesce(luhn(digits), F.lit(False)) | (hit.rlike("^[A-Z]") & (remainder_97(hit) == 1))
        bare = hit.rlike("^[0-9]+$")
        grouped = hit.rlike(r"^\(?[0-9+]{1,4}\)?[ .-]\(?[0-9]{2,4}\)?[ .-]") | hit.rlike(r"^\([0-9]+\) ?[0-9]+-")
        dated = hit.rlike(r"^[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|^[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}|^[0-9]{1,3}(?:[ .][0-9]{3})+$|^[0-9]+[./][0-9]+$")
        return cue + [hit.startswith("+"), hit.contains("("), bare, grouped, dated, n < 9, n.between(9, 11), n.between(12, 15), valid, right.rlike(r"^[\p{L}\p{N}%$€£\"]") | left.rlike(r"[\p{L}\p{N}$€£=\"]$")]
    return cue + [hit.rlike(r"^(?:" + any_of(TITLES) + r")\.? "), hit.rlike(r"^(?:\S+ )?(?:" + any_of(GIVEN_NAMES) + ")"), hit.rlike(r"^\S+ \S+ \S+"), left.rlike(r"[\p{Ll},] $"), right.rlike(r"^ \p{Lu}"), right.rlike(r"^[,.;)]")]


def found_in(docs: DataFrame) -> DataFrame:
    """(row, doc_id, found): of each text the matches of every pattern, with the lengths and ends of what lies between.

    ``found`` has one entry for each kind that occurs: kind, hits, and the pieces that the hits part, as length, last
    and first characters. No text is carried on.
    """

    def of(kind: str) -> Column:
        text, pattern = F.col("text"), PATTERNS[kind]
        pieces = F.transform(F.split(text, pattern, -1), lambda p: F.struct(F.length(p).alias("gap"), F.right(p, F.lit(LEFT)).alias("left"), F.left(p, F.lit(RIGHT)).alias("right")))
        made = F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), pieces.alias("pieces"))
        return F.when(NEEDS[kind](text), made)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = F.filter(F.array(*map(of, KINDS)), lambda k: k.isNotNull() & (F.size(k["hits"]) > 0))
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", found.alias("found"))


def spans_of(found: DataFrame) -> DataFrame:
    """(row, kind, start, end, hit, left, right): base matches that pass, and other forms that touch none of them.

    Starts are running sums over a text's matches. A document's matches meet in one task, nothing more.
    """
    by_row = found.select("row", F.inline("found")).repartition("row")
    n = F.size("hits")
    zipped = F.arrays_zip(F.col("hits").alias("hit"), F.slice("pieces", F.lit(1), n).alias("before"), F.slice("pieces", F.lit(2), n).alias("after"))
    at = by_row.select("row", "kind", F.posexplode(zipped).alias("i", "m")).select("row", "kind", "i", "m.hit", F.col("m.before.gap").alias("gap"), F.col("m.before.left").alias("left"), F.col("m.after.right").alias("right"))
    upto = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("hit")).over(upto)
    at = at.withColumn("end", end).withColumn("start", F.col("end") - F.length("hit"))
    part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
    is_kind = lambda name: F.col("kind") == KINDS.index(name)
    fails = F.when(is_kind("ip"), ~F.col("hit").rlike(rf"^{part}(?:\.{part}){{3}}$"))
    fails = fails.when(is_kind("card"), ~F.coalesce(luhn(digits_of(F.col("hit"))), F.lit(False))).when(is_kind("phone"), ~F.length(digits_of(F.col("hit"))).between(9, 15)).otherwise(False)
    at = at.where(~fails)
    base = F.col("kind") < len(BASE)
    before = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy("row").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, 0)
    reach = F.coalesce(F.max(F.when(base, F.col("end"))).over(before), F.lit(-1))
    ahead = F.coalesce(F.min(F.when(base, F.col("start"))).over(behind), F.lit((1 << 63) - 1))
    free = at.withColumn("reach", reach).withColumn("ahead", ahead).where(base | ((F.col("reach") <= F.col("start")) & (F.col("ahead") >= F.col("end"))))
    return free.select("row", "kind", "start", "end", "hit", "left", "right")


def judged(spans: DataFrame) -> DataFrame:
    """(row, kind, start, end, family, votes, looks): all votes of a span in one number to base 3, its features in one of bits."""
    per = [(i, labelers(f), looks(f)) for i, f in enumerate(FAMILIES)]
    family = F.element_at(F.array(*[F.lit(FAMILY.get(k, -1)) for k in KINDS]), F.col("kind") + 1)
    votes = F.lit(0)
    seen = F.lit(0)
    for i, votes_of, looks_of in per:
        code = sum(((v.vote + 1) * 3**j for j, v in enumerate(votes_of)), F.lit(0))
        bits = sum((F.when(c, 1 << j).otherwise(0) for j, c in enumerate(looks_of)), F.lit(0))
        votes = F.when(F.col("family") == i, code).otherwise(votes)
        seen = F.when(F.col("family") == i, bits).otherwise(seen)
    return spans.withColumn("family", family).select("row", "kind", "start", "end", "family", votes.alias("votes"), seen.alias("looks"))


def believe(votes: np.ndarray, times: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over vote patterns: beliefs of patterns, rates[y, labeler, vote + 1], and the prior.

    ``votes`` holds -1, 0 and 1, one row for each pattern seen ``times`` times. Labelers are taken to err
    independently, given the truth. Beliefs begin with the majority; rates are smoothed by one vote of each sort.
    """
    belief = np.clip(0.5 + 0.2 * votes.sum(axis=1), 0.05, 0.95)
    shown = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    for _ in range(rounds):
        prior = (1 + belief @ times) / (2 + times.sum())
        rates = np.stack([np.einsum("p,pjv->jv", b * times, shown) + 1 for b in (1 - belief, belief)])
        rates /= rates.sum(axis=2, keepdims=True)
        odds = np.log(prior / (1 - prior)) + np.einsum("pjv,jv->p", shown, np.log(rates[1] / rates[0]))
        now = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        if np.abs(now - belief).max(initial=0.0) < 1e-9:
            break
        belief = now
    return belief, rates, float(prior)


def fit_looks(looks: np.ndarray, times: np.ndarray, sure: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Logistic weights, the bias first, of 0/1 features for beliefs ``sure``, each pattern seen ``times`` times; Newton steps."""
    x = np.hstack([np.ones((len(looks), 1)), looks])
    w = np.zeros(x.shape[1])
    hold = np.full(x.shape[1], ridge)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (times * (sure - p)) - hold * w
        curve = (x * (times * p * (1 - p))[:, None]).T @ x + np.diag(hold)
        step = np.linalg.solve(curve, slope)
        w = w + step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return w


@dataclass
class Classifier:
    """Weights of looks by family, bias first, and what was learned of the labelers: name to (vote -1, 0, 1) rates by truth."""

    weights: dict[int, np.ndarray]
    trust: dict[tuple[str, str], np.ndarray]

    def score(self) -> Column:
        """The log odds of a span with columns family and looks; -1 where a family was never seen."""
        out = F.lit(-1.0)
        for i, w in self.weights.items():
            bits = sum((F.when(F.col("looks").bitwiseAND(1 << j) != 0, float(v)).otherwise(0.0) for j, v in enumerate(w[1:])), F.lit(float(w[0])))
            out = F.when(F.col("family") == i, bits).otherwise(out)
        return out


def fit(spans: DataFrame) -> Classifier:
    """The classifier of ``judged`` spans, all of them.

    Votes are counted by pattern and beliefs by pattern of looks, in Spark: what the driver gets is bounded by the
    number of patterns (at most 3 ** 7 votes and 2 ** 12 looks a family), however many spans there are.
    """
    spans = spans.where("family >= 0")
    counted = spans.groupBy("family", "votes").count().collect()
    wide = 3**7
    sure = np.zeros(len(FAMILIES) * wide)
    trust = {}
    for i, name in enumerate(FAMILIES):
        have = [(r["votes"], r["count"]) for r in counted if r["family"] == i]
        if have:
            names = [v.name for v in labelers(name)]
            code, times = np.array(have).T
            belief, rates, _ = believe(np.stack([code // 3**j % 3 - 1 for j in range(len(names))], axis=1), times.astype(float))
            sure[i * wide + code] = belief
            trust |= {(name, v): rates[:, j] for j, v in enumerate(names)}
    believed = F.element_at(F.array(*[F.lit(float(v)) for v in sure]), F.col("family") * wide + F.col("votes") + 1)
    seen = spans.groupBy("family", "looks").agg(F.count("*").alias("n"), F.avg(believed).alias("sure")).collect()
    weights = {}
    for i, name in enumerate(FAMILIES):
        rows = [(r["looks"], r["n"], r["sure"]) for r in seen if r["family"] == i]
        if rows:
            code, times, mean = (np.array(c) for c in zip(*rows, strict=True))
            weights[i] = fit_looks(np.stack([code >> j & 1 for j in range(len(looks(name)))], axis=1).astype(float), times.astype(float), mean)
    return Classifier(weights, trust)


def find_personal(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_added, base, spans) of every text.

    ``base`` lists the matches of the four fixed patterns as kind:start:end in code points, end exclusive, by start, then
    kind; ``spans`` also the spans of other forms (addresses spelled out, numbers without a plus, account numbers,
    names) that the classifier takes for personal data and that touch no base span. Added spans of two kinds may overlap.

    The texts are read once; what the patterns found is written without the texts, and so are the votes. Labelers are
    weighed over all spans of all documents.

    Edge cases: null and empty texts have no spans; very long texts and tokens are read whole; repeated rows agree, one
    row each; null doc_ids stay; an empty table gives no rows; other columns are not read.
    """
    found = durable(found_in(docs), "found")
    spans = durable(judged(spans_of(found)), "spans")
    added = fit(spans).score() >= 0
    kept = spans.where((F.col("kind") < len(BASE)) | added).select("row", F.lit(None).cast("long").alias("doc_id"), F.struct("start", "kind", "end").alias("span"))
    every = found.select("row", "doc_id", F.lit(None).cast("struct<start: long, kind: int, end: long>").alias("span")).unionByName(kept)
    counts = [F.count_if(F.col("span.kind") == i).alias(f"n_{k}") for i, k in enumerate(BASE)]
    whole = every.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *counts, F.count_if(F.col("span.kind") >= len(BASE)).alias("n_added"), F.sort_array(F.collect_list("span")).alias("all"))
    names = F.array(*map(F.lit, KINDS))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    base = F.filter("all", lambda s: s["kind"] < len(BASE))
    return whole.select("doc_id", *[f"n_{k}" for k in BASE], "n_added", listed(base).alias("base"), listed(F.col("all")).alias("spans"))
