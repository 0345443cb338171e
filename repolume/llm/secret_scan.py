"""Secret scans through an inverted index of trigrams.

From each rule's regular expression the strings are derived of which one must occur in every
match, and from them a Boolean query: any of its clauses, where a clause is all trigrams of
one string. The index holds postings (trigram, document) of the trigrams that some clause
names; clauses are answered by intersecting postings, and only the documents found are
searched with the rule's expression. A rule without a mandatory trigram searches them all.

The trigrams are worked out on the driver from the list of rules, whatever the data. All
work on documents is DataFrame expressions and joins. Places of matches come from the
lengths of the matches and of the parts between them.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as kinds
from re import _parser as parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A kind, its expression (as in Java and Python alike), and the least length of a
    group's match; shorter matches are dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# A private key runs to its END line with no other such line in between. Where that is missing,
# it is the base64 after the header, in lines of 16 characters or more and a last one of any
# length, whatever marks the lines begin with, escaped line ends included. Expressions are such
# that three engines agree: without looking ahead, without large counts in counts. Java nests
# once for each turn of a group of varying length, so these have a limit: 400 dashes on the way
# to END; without END 200 lines, beside any number of plain ones of 64, 70 or 76 characters.
_NAME = r"[A-Z0-9\x20]*PRIVATE\x20KEY(?:\x20BLOCK)?-*"
_MARKS = r"[\x20\x09-\x0D\\>#*|\"',;-]*"
_BASE64 = r"[A-Za-z0-9+/]"
_TO_END = rf"[^-]*(?:--?-?-?[^-]+){{0,400}}-----+END\x20{_NAME}"
_HEADERS = rf"(?:{_MARKS}(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID):[^\n\\]*){{0,20}}"
_LINE = rf"{_MARKS}{_BASE64}{{16,}}=?=?"
_PLAIN = "".join(
    rf"(?:{end}{_BASE64}{{{n}}})*{_BASE64}*" for end in (r"\n", r"\r\n", r"\\n") for n in (76, 70, 64)
)
_LAST = rf"(?:{_MARKS}{_BASE64}{{0,15}}==?|{_MARKS}{_BASE64}{{1,15}}(?:[\x09-\x0D\\]|$))?"
_LINES = rf"{_HEADERS}{_LINE}{_PLAIN}{f'(?:{_LINE})?' * 200}{_LAST}(?:{_MARKS}={_BASE64}{{4}})?"

BASE_RULES = (
    Rule(
        "assign",
        r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # a run shorter than 24 can't be part of a longer one, so this equals dropping short runs
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE_RULES = (
    Rule("private_key", rf"-----BEGIN\x20{_NAME}(?:{_TO_END}|{_LINES}|)"),
    Rule("code_host", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", r"(?:sk|rk)_(?:live|test)_[0-9A-Za-z]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}"),
    # a longer scheme is matched by its end
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]+:[^\s/:@]{3,}@"),
)
RULES = BASE_RULES + MORE_RULES

MOST_STRINGS = 64  # a set of alternatives is not followed beyond this many


def mandatory(pattern: str) -> list[set[str]]:
    """Sets of strings, in lower case: each match holds one string of every set."""
    sets: list[set[str]] = []

    def close(current: set[str]) -> set[str]:
        if any(current):
            sets.append({s.lower() for s in current})
        return {""}

    def exact(nodes) -> set[str] | None:
        """All strings that the nodes match, if they are few."""
        out = {""}
        for node in nodes:
            own = exact_node(*node)
            if own is None or len(out) * len(own) > MOST_STRINGS:
                return None
            out = {a + b for a in out for b in own}
        return out

    def exact_node(op, arg) -> set[str] | None:
        if op is kinds.LITERAL:
            return {chr(arg)}
        if op is kinds.IN and all(o is kinds.LITERAL for o, _ in arg):
            return {chr(a) for _, a in arg}
        if op is kinds.SUBPATTERN:
            return exact(arg[3])
        if op is kinds.BRANCH:
            parts = [exact(p) for p in arg[1]]
            return None if None in parts else set().union(*parts)
        if op is kinds.MAX_REPEAT and arg[1] <= 4:
            one = exact(arg[2])
            if one is None or len(one) ** arg[1] > MOST_STRINGS:
                return None
            out, runs = set(), {""}
            for n in range(arg[1] + 1):
                if n >= arg[0]:
                    out |= runs
                runs = {a + b for a in runs for b in one}
            return out
        return None

    def walk(nodes) -> None:
        current = {""}
        for op, arg in nodes:
            own = exact_node(op, arg)
            if own is not None and len(current) * len(own) <= MOST_STRINGS:
                current = {a + b for a in current for b in own}
                continue
            current = close(current)
            if op is kinds.SUBPATTERN:
                walk(arg[3])
        close(current)

    walk(parser.parse(pattern))
    return sets


def trigrams(text: str) -> list[str]:
    return sorted({text[i : i + 3] for i in range(len(text) - 2)})


def clauses(pattern: str) -> list[list[str]]:
    """The query of an expression: any of these lists, and of a list all trigrams. The set
    with the longest shortest string is the most selective. Empty: scan everything."""
    usable = [s for s in mandatory(pattern) if min(map(len, s)) >= 3]
    if not usable:
        return []
    best = max(usable, key=lambda s: (min(map(len, s)), -len(s)))
    found = {frozenset(trigrams(s)) for s in best}
    # a clause that asks for more than another adds nothing
    return sorted(sorted(c) for c in found if not any(other < c for other in found))


KEY = ["doc_id", "text_hash"]


def keyed(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.col("doc_id").cast("long"), text.alias("text")).withColumn(
        "text_hash", F.xxhash64("text")
    )


def _on_key(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on the key, where null equals null."""
    right = right.withColumnsRenamed({k: f"r_{k}" for k in KEY})
    on = [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in KEY]
    return left.join(right, on[0] & on[1], "left").drop(*(f"r_{k}" for k in KEY))


def postings(documents: DataFrame, wanted: list[str]) -> DataFrame:
    """doc_id, text_hash, trigram: which of the wanted trigrams a text has, in lower case."""
    low = keyed(documents).select(*KEY, F.lower("text").alias("low"))
    found = F.array_compact(
        F.array(*(F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in wanted))
    )
    return low.select(*KEY, F.explode(found).alias("trigram"))


def candidates(documents: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id, text_hash, kinds: the indexed rules whose query a text answers."""
    spark = documents.sparkSession
    queries = {r.kind: clauses(r.pattern) for r in rules}
    rows = [
        F.struct(
            F.lit(kind).alias("kind"),
            F.lit(n).alias("clause"),
            F.lit(len(parts)).alias("needed"),
            F.lit(t).alias("trigram"),
        )
        for kind, query in queries.items()
        for n, parts in enumerate(query)
        for t in parts
    ]
    wanted = sorted({t for query in queries.values() for parts in query for t in parts})
    index = postings(documents, wanted)
    query = spark.range(1).select(F.inline(F.array(*rows)))
    return (
        index.join(F.broadcast(query), "trigram")  # as long as the list of rules
        .groupBy(*KEY, "kind", "clause", "needed")
        .agg(F.countDistinct("trigram").alias("found"))
        .where("found = needed")
        .groupBy(*KEY)
        .agg(F.collect_set("kind").alias("kinds"))
    )


def _matches(rule: Rule, order: int) -> Column:
    """Array of (kind, order, i, before, size, ok): each match, the characters between the
    one before and it, its length, and whether it counts."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all("text", pattern, F.lit(0))
    held = F.regexp_extract_all("text", pattern, F.lit(rule.group)) if rule.group else whole
    sizes = F.zip_with(
        whole,
        held,
        lambda a, b: F.struct(
            F.length(a).alias("size"), (F.length(b) >= rule.least).alias("ok")
        ),
    )
    between = F.split("text", rule.pattern, -1)
    out = F.zip_with(
        between,
        sizes,
        lambda part, m: F.struct(
            F.lit(rule.kind).alias("kind"),
            F.lit(order).alias("order"),
            F.length(part).alias("before"),
            m["size"].alias("size"),
            m["ok"].alias("ok"),
        ),
    )
    return F.when(F.col("text").rlike(rule.pattern), out)


def spans(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, text_hash, kind, order, start, end: every match that counts, in code points,
    once for all equal rows."""
    scanned = {r.kind for r in rules if not clauses(r.pattern)}
    docs = _on_key(keyed(documents), candidates(documents, rules))
    arrays = []
    for order, rule in enumerate(rules):
        own = _matches(rule, order)
        if rule.kind not in scanned:
            own = F.when(F.array_contains("kinds", rule.kind), own)
        arrays.append(F.coalesce(own, F.array().cast(MATCH)))
    found = docs.select(*KEY, F.posexplode(F.concat(*arrays)).alias("i", "m"))
    found = found.where("m.size IS NOT NULL").select(*KEY, "i", "m.*")
    # equal rows give equal matches
    found = found.groupBy(*KEY, "kind", "order", "i").agg(
        *(F.first(c).alias(c) for c in ("before", "size", "ok"))
    )
    end = F.sum(F.col("before") + F.col("size")).over(
        Window.partitionBy(*KEY, "kind").orderBy("i")
    )
    found = found.withColumn("end", end).where("ok")
    return found.select(*KEY, "kind", "order", (F.col("end") - F.col("size")).alias("start"), "end")


MATCH = "array<struct<kind:string,order:int,before:int,size:int,ok:boolean>>"


def scan(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, text_hash and ``found`` for every row: an array of (start, order, kind, end),
    sorted; empty for a text without a match.

    Null and empty texts have no match. Repeated rows and rows with a null id each get their
    own result. Only ``doc_id`` and ``text`` are read; other columns may have any name.
    """
    per_text = (
        spans(documents, rules)
        .groupBy(*KEY)
        .agg(F.sort_array(F.collect_list(F.struct("start", "order", "kind", "end"))).alias("found"))
    )
    none = F.array().cast("array<struct<start:bigint,order:int,kind:string,end:bigint>>")
    out = _on_key(keyed(documents).select(*KEY), per_text)
    return out.withColumn("found", F.coalesce("found", none))


def span_text(found: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def redact(documents: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """``documents`` with every span of ``scan`` replaced by ``mark``, overlapping and touching
    spans as one; ``n_chars`` follows where there is such a column. Texts without a span, and
    null texts, stay as they are."""
    found = scan(documents, rules).where(F.size("found") > 0).dropDuplicates(KEY)
    names = documents.columns
    # the row travels as one column, so that no name can clash
    docs = documents.select(
        F.struct("*").alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("text_hash", F.xxhash64("text"))
    docs = _on_key(docs, found)
    start = F.struct(
        F.lit(0).cast("long").alias("at"), F.lit("").alias("out"), F.lit(False).alias("open")
    )

    def step(state: Column, s: Column) -> Column:
        apart = s["start"] > state["at"]
        gap = F.substr(F.col("text"), state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        fresh = apart | ~state["open"]
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"]).alias("out"),
            F.lit(True).alias("open"),
        )

    clean = F.aggregate(
        "found",
        start,
        step,
        lambda state: F.concat(state["out"], F.substr(F.col("text"), state["at"] + 1)),
    )
    docs = docs.withColumn("clean", F.when(F.col("found").isNotNull(), clean))
    new = {
        "text": F.coalesce("clean", "row.text"),
        "n_chars": F.coalesce(F.length("clean").cast("long"), "row.n_chars")
        if "n_chars" in names
        else None,
    }
    return docs.select(*(new.get(n, F.col(f"row.`{n}`")).alias(n) for n in names))
