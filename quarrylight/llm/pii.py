"""Personal data by weak supervision, with DataFrame and SQL functions only.

Base spans come from the patterns of four kinds; a match that fails its check
(address parts, Luhn digits, number of digits) is no base span.  Candidates are
all matches, failed ones too, tokens that look like keys, values that stand
behind a key's name, and numbers that stand behind a cue for telephones.  Four
labelers vote on a candidate, yes, no or nothing:

* regex: the strict pattern and its check;
* gazetteer: known card prefixes, mail domain endings, dialling codes, key names;
* context: cue words or an assignment sign just before the candidate;
* shape: digits and letters mixed, length, repeated characters.

For each kind apart, the votes are counted by pattern (a bounded table), and
expectation-maximisation over those counts estimates the share of true spans and
each labeler's reliability.  Its posteriors train the kind's span classifier:
naive Bayes over the votes and over what no labeler sees, the characters beside
the candidate, its share of digits and its length.  Candidates that it takes for
true are added (those that failed a check, or that only context proposes, if it
is sure), where no base span is; base spans always stay.

How places are found without a function for them: matches are put between two
marks (private-use characters, of which the text has none after `translate`);
the place of a match is the sum of the lengths of the pieces before its mark,
less the marks in them.

Edge cases: null and empty texts have no spans; rows that share a doc_id are
returned each; places count code points; other columns are ignored; a table
without candidates trains nothing and adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: Kinds in their order at one place.
KINDS = ("email", "ip", "card", "phone", "secret")

# What is searched for, as what may come before (group 1) and the match (group 2).  Possessive quantifiers
# and the look-behinds keep the leftmost match while long runs are not tried from each of their places.
PATTERNS = {
    "email": r"()((?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)",
    "ip": r"()((?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++)",
    "card": r"()((?<![0-9])[0-9](?:[ -]?[0-9])++)",
    "phone": r"()(\+[0-9][ ().0-9-]+[0-9])",
    "secret": r"()((?<![A-Za-z0-9])[A-Za-z0-9]{20,}+)",
}
#: Candidates that the gazetteer and the context propose: (kind, pattern).
PROPOSED = (
    ("secret", r"(?i)((?<![A-Za-z])(?:token|secret|passw(?:or)?d|passwd|pwd|(?:api|access|private)[_ -]?key|credentials?)[\"']?\s{0,2}[=:]\s{0,2}[\"']?)([^\s\"'<>,;]{6,200}+)"),
    ("phone", r"(?i)()([0-9(](?<=(?<![a-z])(?:phone|tel|telephone|mobile|call|fax)[.:]{0,2}\s{0,2}.)[ ().0-9-]{6,30}[0-9])"),
)
# Gazetteers of the labelers.
MAIL_ENDINGS = r"\.(com|org|net|edu|gov|io|de|fr|es|uk|eu|info|example)$"
CARD_PREFIXES = r"^(4|5[1-5]|2[2-7]|3[47]|6)"
DIAL_CODES = r"^\+(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
KEY_NAMES = r"(?i)(token|secret|key|passw|pwd|auth|bearer|credential)"
CUES = r"(?i)(mail|contact|phone|tel|call|fax|card|visa|account|ip|addr|host|server|token|secret|key|passw|login)[a-z]*\W{0,4}$"

_OPEN, _CLOSE = "", ""


#: Share of true spans that may fail their check: what is known of the first labeler, lest EM takes a failed check for noise.
MOST_FAILED = 0.02
#: Pieces of a text whose places are summed up together.
_BLOCK = 1000


def _starts(pieces: F.Column) -> F.Column:
    """Where each piece but the first begins, less the closing marks before it: block by block, so that many matches stay cheap."""
    zero = F.lit(0).cast("long")
    sizes = F.transform(pieces, lambda p, i: F.length(p).cast("long") - F.when(i > 0, 1).otherwise(0))
    total = lambda xs: F.aggregate(xs, zero, lambda s, x: s + x)

    def block(c: F.Column) -> F.Column:
        begin = F.struct(total(F.slice(sizes, F.lit(1), c * _BLOCK)).alias("at"), F.array().cast("array<bigint>").alias("found"))
        return F.aggregate(F.slice(sizes, c * _BLOCK + 1, F.lit(_BLOCK)), begin, lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["found"], s["at"] + x).alias("found")), lambda s: s["found"])

    return F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / _BLOCK).cast("int")), block))


def _matches(text: F.Column, pattern: str) -> F.Column:
    """array<struct<start, end, text, before, after>> of a pattern's matches; before: up to 24 characters since the last match, after: one."""
    marked = F.regexp_replace(text, F.lit(pattern), F.lit("$1" + _OPEN + "$2" + _CLOSE))

    def of(pieces: F.Column) -> F.Column:
        def all_of(starts: F.Column) -> F.Column:
            def one(piece: F.Column, i: F.Column) -> F.Column:
                found, start = F.substring_index(piece, _CLOSE, 1), F.get(starts, i)
                before = F.right(F.translate(F.get(pieces, i), _CLOSE, ""), F.lit(24))
                return F.struct(start.alias("start"), (start + F.length(found)).cast("long").alias("end"), found.alias("text"), before.alias("before"), F.left(F.substring_index(piece, _CLOSE, -1), F.lit(1)).alias("after"))

            return F.transform(F.slice(pieces, F.lit(2), F.greatest(F.lit(0), F.size(pieces) - 1)), one)

        return F.when(F.size(pieces) > 1, F.element_at(F.transform(F.array(_starts(pieces)), all_of), 1)).otherwise(F.array().cast(_MATCH))

    return F.element_at(F.transform(F.array(F.split(marked, _OPEN)), of), 1)


_MATCH = "array<struct<start:bigint,end:bigint,text:string,before:string,after:string>>"


def _digits(text: F.Column) -> F.Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: F.Column) -> F.Column:
    """Is the check sum of a string of digits right?"""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)))
    return F.aggregate(places, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, text: F.Column) -> F.Column:
    n = F.length(_digits(text))
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda p: F.rlike(p, F.lit(r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$")))
    if kind == "card":
        return n.between(12, 19) & luhn(_digits(text))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _votes(kind: str, x: F.Column) -> list[F.Column]:
    """Votes of the labelers: 1, -1 or 0 for none."""
    text, before = x["text"], x["before"]
    yes = lambda c: F.when(c, 1).otherwise(0)
    either = lambda c: F.when(c, 1).otherwise(-1)
    mixed = F.rlike(text, F.lit("[0-9]")) & F.rlike(text, F.lit("[A-Za-z]"))
    few = F.size(F.array_distinct(F.split(text, ""))) < 6
    strict = {"secret": F.when(mixed & F.rlike(text, F.lit("^([0-9a-f]{20,}|[0-9A-Za-z]{32,})$")), 1).when(~mixed, -1).otherwise(0)}.get(kind, either(_valid(kind, text)))
    known = {"email": F.rlike(text, F.lit(MAIL_ENDINGS)), "card": F.rlike(text, F.lit(CARD_PREFIXES)), "phone": F.rlike(text, F.lit(DIAL_CODES)), "ip": ~F.rlike(text, F.lit(r"^(0|255)\."))}.get(kind, F.rlike(before, F.lit(KEY_NAMES)))
    context = F.when(F.rlike(before, F.lit(CUES)) | F.rlike(before, F.lit("[=:]\\s*[\"']?$")), 1).when(F.rlike(before, F.lit("[A-Za-z0-9]$")), -1).otherwise(0)
    shape = F.when(few, -1).when(mixed | F.lit(kind != "secret"), 1).otherwise(-1)
    return [strict, yes(known), context, shape]


def _class(c: F.Column) -> F.Column:
    """A character as one letter for its class."""
    return F.when(c == "", "e").when(F.rlike(c, F.lit(r"\p{L}")), "l").when(F.rlike(c, F.lit(r"\p{N}")), "n").when(F.rlike(c, F.lit(r"\s")), "b").when(F.rlike(c, F.lit("[\"'`]")), "q").otherwise("p")


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and found: array<struct<start, kind (its number), end, ok, pattern, parts>>, in order."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _OPEN + _CLOSE, "")

    def of(kind: str, pattern: str, base: bool) -> F.Column:
        number = KINDS.index(kind)

        def one(x: F.Column) -> F.Column:
            votes = F.concat_ws(",", *[v.cast("string") for v in _votes(kind, x)])
            size = x["end"] - x["start"]
            digits = F.floor(10 * F.length(_digits(x["text"])) / F.greatest(F.lit(1), size))
            parts = F.array(*[F.concat(F.lit(f"{number}{name}"), v.cast("string")) for name, v in (("s", F.least(F.lit(9), F.floor(size / 6))), ("d", digits), ("b", _class(F.right(x["before"], F.lit(1)))), ("a", _class(x["after"])))])
            return F.struct(x["start"].alias("start"), F.lit(number).alias("kind"), x["end"].alias("end"), (_valid(kind, x["text"]) & F.lit(base)).alias("ok"), votes.alias("pattern"), parts.alias("parts"))

        return F.transform(_matches(F.col("t"), pattern), one)

    kind = "array<struct<start:bigint,kind:int,end:bigint,ok:boolean,pattern:string,parts:array<string>>>"
    assigned = F.contains("t", F.lit("=")) | F.contains("t", F.lit(":"))
    proposed = [F.when(assigned, of(k, p, False)).otherwise(F.array().cast(kind)) if k == "secret" else of(k, p, False) for k, p in PROPOSED]
    every = F.concat(*[of(k, PATTERNS[k], True) for k in KINDS], *proposed)
    # What two patterns propose alike stands once, the base match first.
    once = lambda xs: F.filter(xs, lambda x, i: (i == 0) | ~F.coalesce(_same(F.get(xs, i - 1), x), F.lit(False)))
    ordered = F.sort_array(F.transform(every, lambda x: x.withField("ok", ~x["ok"])))
    found = F.when(F.col("some"), F.transform(F.element_at(F.transform(F.array(ordered), once), 1), lambda x: x.withField("ok", ~x["ok"]))).otherwise(F.array().cast(kind))
    some = F.rlike("t", F.lit("[0-9@]")) | F.rlike("t", F.lit(PATTERNS["secret"])) | assigned
    return docs.select(F.col("doc_id").cast("long"), text.alias("t")).withColumn("some", some).select("doc_id", found.cast(kind).alias("found"))


def _same(x: F.Column, y: F.Column) -> F.Column:
    return (x["kind"] == y["kind"]) & (x["start"] == y["start"]) & (x["end"] == y["end"])


def estimate(found: DataFrame, rounds: int = 40) -> DataFrame:
    """(kind, pattern, posterior): expectation-maximisation over each kind's counts of patterns, as one SQL expression.

    The state is the share of true spans and, for each labeler, the chances of a
    yes and a no vote on true and on false candidates.
    """
    counts = found.select(F.explode("found").alias("x")).groupBy("x.kind", "x.pattern").agg(F.count(F.lit(1)).cast("double").alias("n"))
    votes = F.transform(F.split("pattern", ","), lambda v: v.cast("int"))
    row = counts.select("kind", F.struct("pattern", votes.alias("v"), "n").alias("p")).groupBy("kind").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    m = 4
    start = F.struct(F.lit(0.5).alias("prior"), *[F.lit(x).alias(f"{s}{i}") for i in range(m) for s, x in (("ty", 0.7), ("tn", 0.1), ("fy", 0.2), ("fn", 0.4))])

    def posterior(s: F.Column, p: F.Column) -> F.Column:
        def chance(side: str) -> F.Column:
            out = s["prior"] if side == "t" else 1 - s["prior"]
            for i in range(m):
                v = p["v"][i]
                out = out * F.when(v == 1, s[f"{side}y{i}"]).when(v == -1, s[f"{side}n{i}"]).otherwise(1 - s[f"{side}y{i}"] - s[f"{side}n{i}"])
            return out

        return F.element_at(F.transform(F.array(F.struct(chance("t").alias("t"), chance("f").alias("f"))), lambda c: c["t"] / (c["t"] + c["f"])), 1)

    fields = [("all", lambda x: x["n"]), ("t", lambda x: x["t"])]
    for i in range(m):
        for name, vote in (("y", 1), ("n", -1)):
            fields.append((f"t{name}{i}", lambda x, i=i, vote=vote: F.when(x["v"][i] == vote, x["t"]).otherwise(0.0)))
            fields.append((f"f{name}{i}", lambda x, i=i, vote=vote: F.when(x["v"][i] == vote, x["n"] - x["t"]).otherwise(0.0)))

    def updated(total: F.Column) -> F.Column:
        t, f = total["t"], total["all"] - total["t"]
        smooth = lambda k, side: ((total[k] + 1.0) / (side + 3.0)).alias(k)
        new = [((t + 1.0) / (total["all"] + 2.0)).alias("prior")]
        for i in range(m):
            no = smooth(f"tn{i}", t)
            new += [smooth(f"ty{i}", t), F.least(no, F.lit(MOST_FAILED)).alias(f"tn{i}") if i == 0 else no, smooth(f"fy{i}", f), smooth(f"fn{i}", f)]
        return F.struct(*new)

    def step(s: F.Column, _: F.Column) -> F.Column:
        weighed = F.transform("ps", lambda p: F.struct(p["v"].alias("v"), p["n"].alias("n"), (p["n"] * posterior(s, p)).alias("t")))
        zero = F.struct(*[F.lit(0.0).alias(k) for k, _ in fields])
        total = F.aggregate(weighed, zero, lambda a, x: F.struct(*[(a[k] + f(x)).alias(k) for k, f in fields]))
        return F.element_at(F.transform(F.array(total), updated), 1)

    state = row.select("kind", "ps", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("s"))
    return state.select("kind", F.explode(F.transform("ps", lambda p: F.struct(p["pattern"].alias("pattern"), posterior(F.col("s"), p).alias("posterior")))).alias("e")).select("kind", "e.*")


def _evidence(kind: F.Column, pattern: F.Column, parts: F.Column) -> F.Column:
    """What the classifier sees of a candidate: its votes and its own parts, by kind."""
    return F.concat(parts, F.transform(F.split(pattern, ","), lambda v, i: F.concat(kind.cast("string"), F.lit("v"), i.cast("string"), F.lit(":"), v)))


def classifier(found: DataFrame, posteriors: DataFrame) -> DataFrame:
    """One row: the log odds of a true span for each piece of evidence (a few hundred at most) and each kind's intercept."""
    classes = found.select(F.explode("found").alias("x")).groupBy("x.kind", "x.pattern", "x.parts").agg(F.count(F.lit(1)).cast("double").alias("n"))
    same = (F.col("c.kind") == F.col("p.kind")) & (F.col("c.pattern") == F.col("p.pattern"))
    weighed = classes.alias("c").join(F.broadcast(posteriors.alias("p")), same).select("c.kind", _evidence(F.col("c.kind"), F.col("c.pattern"), F.col("c.parts")).alias("parts"), (F.col("n") * F.col("posterior")).alias("t"), (F.col("n") * (1 - F.col("posterior"))).alias("f"))
    features = weighed.select("kind", F.explode("parts").alias("part"), "t", "f").groupBy("kind", "part").agg(F.sum("t").alias("t"), F.sum("f").alias("f"))
    totals = weighed.groupBy("kind").agg(F.sum("t").alias("tt"), F.sum("f").alias("ff"))
    odds = features.join(F.broadcast(totals), "kind").select("part", (F.log((F.col("t") + 0.5) / (F.col("tt") + 1)) - F.log((F.col("f") + 0.5) / (F.col("ff") + 1))).alias("odds"))
    bases = totals.select(F.col("kind").cast("string").alias("part"), F.log((F.col("tt") + 1) / (F.col("ff") + 1)).alias("odds"))
    return odds.unionByName(bases).agg(F.map_from_entries(F.collect_list(F.struct("part", "odds"))).alias("log_odds"))


def find_pii(docs: DataFrame, threshold: float = 0.0, sure: float = 4.0) -> DataFrame:
    """doc_id, base and all: arrays of struct<start, kind, end, name>, in order; all has the added spans too.

    A key-like token is added where the classifier's log odds are above
    `threshold`, a candidate of the four base kinds where they are above `sure`.
    """
    found = C.checkpoint(candidates(docs))
    model = classifier(found, estimate(found))
    names = F.array(*[F.lit(k) for k in KINDS])

    def score(x: F.Column) -> F.Column:
        odds = lambda p: F.coalesce(F.element_at(F.col("log_odds"), p), F.lit(0.0))
        return F.aggregate(_evidence(x["kind"], x["pattern"], x["parts"]), odds(x["kind"].cast("string")), lambda s, p: s + odds(p))

    secret = KINDS.index("secret")
    is_base = lambda x: (x["kind"] < secret) & x["ok"]
    show = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.element_at(names, x["kind"] + 1).alias("name"))
    meets = lambda x, y: (x["start"] < y["end"]) & (y["start"] < x["end"])
    base = F.transform(F.filter("found", is_base), show)
    more = F.filter("found", lambda x: ~is_base(x) & (score(x) > F.when(x["kind"] == secret, threshold).otherwise(sure)))
    split = found.crossJoin(F.broadcast(model)).select("doc_id", base.alias("base"), F.transform(more, show).alias("more"))
    # Of added spans that meet the first one stays, of those at one place the first kind.
    free = F.filter("more", lambda x: ~F.exists("base", lambda b: meets(b, x)))
    added = F.aggregate(free, F.array().cast("array<struct<start:bigint,kind:int,end:bigint,name:string>>"), lambda s, x: F.when((F.size(s) > 0) & (F.element_at(s, -1)["end"] > x["start"]), s).otherwise(F.array_append(s, x)))
    return split.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("all"))
