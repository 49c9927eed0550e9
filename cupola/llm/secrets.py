"""Secret scan in DataFrame expressions only: pattern kinds, and sliding-window entropy of candidate strings.

Base kinds are matched leftmost and without overlap, each by itself: assignments to a secret-like name, access
keys, long hexadecimal runs. The method adds `entropy_hex` and `entropy_base64` spans. A candidate is a run of 20
or more of A-Z a-z 0-9 + / _ = - that holds a digit. A window of 20 characters slides over it; the counts of its
symbols, and of its digits, small and capital letters, signs and non-hexadecimal characters of either case, change by
the character that enters and the one that leaves, and the entropy follows from sum(c log2 c), kept in whole
micro-units so that it stays exact. A window is judged by the class that it uses, each with its own threshold: hex
(digits and a-f, or digits and A-F), single (digits and letters of one case, no signs, as slugs and paths have), and
base64 (digits and letters of both cases); each must hold a digit and its letters. Windows of hex give `entropy_hex`,
those of single and base64 `entropy_base64`; windows of one kind that touch are merged to one span. Windows that
overlap a match of an allow-list pattern add nothing, others of the same candidate do; base kinds are never suppressed.

Null and empty texts have no spans. Every row is kept, with repeated ids too; other columns are not looked at.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cupola.llm.common import bound, table

#: Kind, pattern, group to measure, its least length.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # equal to [0-9a-f]+ with shorter matches dropped, as runs are maximal
)
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits a character that a window of the class must reach.
THRESHOLDS = {"hex": 3.0, "base64": 3.8, "single": 3.3}
#: Parts of candidates that are no secrets: placeholders, counting sequences, digests of nothing.
ALLOWED = (
    r"(?i)example|placeholder|dummy|changeme|your[_-]?(api|secret|token|key)",
    r"(?i)x{8}|0123456789|abcdefghij",
    r"d41d8cd98f00b204e9800998ecf8427e|da39a3ee5e6b4b0d3255bfef95601890afd80709|e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MARK = "[SECRET]"
#: Windows of a block of a candidate, and characters of a chunk of a text.
BLOCK, CHUNK = 1_024, 4_096
#: Counts of symbols that a 64-bit number holds, and their bits.
SLOTS, BITS = 12, 5
SPAN = "array<struct<start:int,end:int,kind:int>>"


#: Elements of an array that a fold copies at most at each step.
PART = 128


def scanned(values: Column, op, zero: Column) -> Column:
    """Running values op(...op(op(zero, v0), v1)..., vi) of an array. op must be associative, with zero as its neutral element.

    A fold that appends copies its result at every step; here it does so only inside parts of PART elements and over
    the parts' last values, so the cost stays in proportion to the array.
    """
    fold = lambda x: F.aggregate(x, F.array(zero), lambda acc, v: F.concat(acc, F.array(op(F.element_at(acc, -1), v))))
    parts = lambda v: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(v) - 1) / PART).cast("int"))), lambda k: fold(F.slice(v, k * PART + 1, F.lit(PART))))
    whole = lambda made: F.flatten(F.zip_with(made, F.slice(fold(F.transform(made, lambda x: F.element_at(x, -1))), F.lit(1), F.size(made)), lambda x, ahead: F.transform(F.slice(x, 2, F.size(x)), lambda v: op(ahead, v))))
    return bound(bound(values, parts), whole)


def _located(text: Column, pattern: str, measured: int = 0) -> Column:
    """All matches in order as structs (start, end, value); value is the measured group. Splitting by the pattern gives what stands between the matches, so positions are running lengths."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(measured)) if measured else whole
    # gap before each match, the match, the measured group; what follows the last match is of no use
    pieces = F.zip_with(F.transform(F.split(text, pattern, -1), F.length), F.arrays_zip(whole.alias("m"), value.alias("v")), lambda gap, x: F.struct(gap.alias("gap"), F.length(x["m"]).alias("n"), x["v"].alias("v")))

    def place(parts: Column) -> Column:
        ends = scanned(F.transform(parts, lambda x: x["gap"] + x["n"]), lambda a, b: a + b, F.lit(0))
        return F.zip_with(parts, ends, lambda x, end: F.struct((end - x["n"]).alias("start"), end.alias("end"), x["v"].alias("v")))

    found = bound(F.filter(pieces, lambda x: x["n"].isNotNull()), place)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:int,end:int,v:string>>"))


def _grouped(items: Column, follows) -> tuple[Column, Column]:
    """(first, last) items of each run of an array in which follows(item, item before) holds from one to the next."""
    before = lambda x, i: F.get(items, i - 1)
    after = lambda x, i: F.get(items, i + 1)
    first = F.filter(items, lambda x, i: ~F.coalesce(follows(x, before(x, i)), F.lit(False)))
    last = F.filter(items, lambda x, i: ~F.coalesce(follows(after(x, i), x), F.lit(False)))
    return first, last


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, in no order; kind is the position in KINDS."""
    kinds = []
    for k, (_, pattern, group, least) in enumerate(BASE):
        kept = F.filter(_located(text, pattern, group), lambda x: F.length(x["v"]) >= least)  # noqa: B023
        kinds.append(F.transform(kept, lambda x: F.struct(x["start"], x["end"], F.lit(k).alias("kind"))))  # noqa: B023
    return F.concat(*kinds)


def _windows(value: Column, offset: Column, spared: Column) -> Column:
    """Spans of a candidate's windows whose entropy reaches the threshold of their class and that overlap none of the spared spans.

    Windows are taken in blocks of BLOCK; a block's fold begins with the characters before its first window's end, so
    all windows are judged, and spans that touch at a block's edge are joined afterwards.
    """
    code = F.filter(F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1), lambda c: c >= 0)

    def blocks(c: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.size(c) - WINDOW) / BLOCK).cast("int"))
        near = lambda k: F.filter(spared, lambda x: (x["end"] > k * BLOCK) & (x["start"] < (k + 1) * BLOCK + WINDOW))
        return F.flatten(F.transform(at, lambda k: _block(F.slice(c, k * BLOCK + 1, F.lit(BLOCK + WINDOW - 1)), k * BLOCK, near(k))))

    def join(spans: Column) -> Column:
        first, last = _grouped(spans, lambda x, was: (x["kind"] == was["kind"]) & (x["start"] <= was["end"]))
        return F.zip_with(first, last, lambda a, b: F.struct((a["start"] + offset).alias("start"), (b["end"] + offset).alias("end"), a["kind"].alias("kind")))

    return bound(bound(code, blocks), join)


def _block(code: Column, begin: Column, spared: Column) -> Column:
    """Spans of the windows of a block. The counts of the window's symbols are kept in whole numbers, SLOTS symbols in each, so a step changes the two counts that change and no others."""
    unit = 1_000_000
    words = -(-len(ALPHABET) // SLOTS)
    # a count can stand at WINDOW + 1 between entering and leaving
    weight = F.array(*[F.lit(round(c * math.log2(c) * unit) if c else 0) for c in range(WINDOW + 2)])
    place = F.array(*[F.lit(1 << (BITS * j)).cast("long") for j in range(SLOTS)])
    part = lambda n: F.get(weight, n)
    # sum(c log2 c) of a window is at most this where its entropy reaches the threshold
    most = {k: math.floor(WINDOW * (math.log2(WINDOW) - t) * unit) for k, t in THRESHOLDS.items()}
    is_in = {"digit": lambda c: c.between(52, 61), "upper": lambda c: c < 26, "lower": lambda c: c.between(26, 51), "sign": lambda c: c > 61, "other": lambda c: ~(c.between(52, 61) | c.between(26, 31)), "capital": lambda c: ~(c.between(52, 61) | (c < 6))}
    one = lambda test, c: F.when(test(c), 1).otherwise(0)
    names = [f"n{w}" for w in range(words)]

    def known(c: Column, name: str) -> list[Column]:
        """What a step needs of a symbol: its number's word, its place in it, and its classes as 0 or 1; all 0 without a symbol."""
        word = F.floor(c / SLOTS).cast("int")
        return [F.coalesce(word, F.lit(-1)).alias(f"{name}w"), F.coalesce(F.get(place, c % SLOTS), F.lit(0)).cast("long").alias(f"{name}p"), (c % SLOTS * BITS).cast("int").alias(f"{name}s"), *[one(t, c).alias(f"{name}{k}") for k, t in is_in.items()]]

    def count(acc: Column, x: Column, name: str) -> Column:
        held = F.lit(0).cast("long")
        for w in range(words):
            held = F.when(x[f"{name}w"] == w, acc[f"n{w}"]) if w == 0 else held.when(x[f"{name}w"] == w, acc[f"n{w}"])
        return F.call_function("shiftright", held, x[f"{name}s"]).bitwiseAND(F.lit((1 << BITS) - 1).cast("long")).cast("int")

    steps = F.transform(code, lambda c, i: F.struct(c.alias("c"), F.get(code, i - WINDOW).alias("o"), i.alias("i")))
    steps = F.transform(steps, lambda x: F.struct(x["c"], x["o"], x["i"], *known(x["c"], "c"), *known(x["o"], "o")))

    def slide(acc: Column, x: Column) -> Column:
        had = count(acc, x, "c")
        left = F.when(x["o"].isNotNull(), count(acc, x, "o") + F.when(x["o"] == x["c"], 1).otherwise(0))
        change = lambda w: F.when(x["cw"] == w, x["cp"]).otherwise(0) - F.when(x["ow"] == w, x["op"]).otherwise(0)
        return F.struct(
            *[(acc[n] + change(w)).cast("long").alias(n) for w, n in enumerate(names)],
            # the entering symbol's count rises first, then the leaving one's falls
            (acc["s"] + part(had + 1) - part(had) + F.coalesce(part(left - 1) - part(left), F.lit(0))).cast("int").alias("s"),
            *[(acc[k] + x[f"c{k}"] - x[f"o{k}"]).cast("int").alias(k) for k in is_in],
            acc["start"], acc["end"], acc["kind"], acc["out"], x["i"].alias("i"),
        )

    def mark(acc: Column) -> Column:
        letters, one_case = acc["lower"] + acc["upper"] > 0, (acc["lower"] == 0) | (acc["upper"] == 0)
        is_hex = (acc["other"] == 0) | (acc["capital"] == 0)
        kind = F.when(
            acc["digit"] > 0,
            F.when(is_hex, F.when(letters & (acc["s"] <= most["hex"]), 3))
            .when(one_case, F.when(letters & (acc["sign"] == 0) & (acc["s"] <= most["single"]), 4))
            .when(acc["s"] <= most["base64"], 4),
        )
        first, stop = acc["i"] - WINDOW + 1 + begin, acc["i"] + 1 + begin
        free = ~F.exists(spared, lambda x: (x["start"] < stop) & (x["end"] > first))
        kind = F.when((acc["i"] >= WINDOW - 1) & F.when(kind.isNotNull(), free), kind)
        grows = (kind == acc["kind"]) & (first <= acc["end"])
        shut = F.when(acc["kind"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(acc["start"], acc["end"], acc["kind"]))))
        fresh = kind.isNotNull() & ~F.coalesce(grows, F.lit(False))
        return F.struct(
            *[acc[n] for n in names], acc["s"], *[acc[k] for k in is_in],
            F.when(fresh, first).otherwise(acc["start"]).alias("start"), F.when(kind.isNotNull(), stop).otherwise(acc["end"]).alias("end"),
            F.coalesce(kind, acc["kind"]).alias("kind"), F.when(fresh, shut).otherwise(acc["out"]).alias("out"), acc["i"],
        )

    zero = F.struct(
        *[F.lit(0).cast("long").alias(n) for n in names], F.lit(0).alias("s"), *[F.lit(0).alias(k) for k in is_in],
        F.lit(0).alias("start"), F.lit(-1).alias("end"), F.lit(None).cast("int").alias("kind"), F.array().cast(SPAN).alias("out"), F.lit(-1).alias("i"),
    )
    return F.aggregate(
        steps, zero, lambda acc, x: bound(slide(acc, x), mark),
        lambda acc: F.when(acc["kind"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(acc["start"], acc["end"], acc["kind"])))),
    )


def _ordered(spans: Column) -> Column:
    return F.transform(F.array_sort(F.transform(spans, lambda x: F.struct(x["start"], x["kind"], x["end"]))), lambda x: F.struct(x["start"], x["end"], x["kind"]))


def _found(docs: DataFrame, text_col: str, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """(row, base, spans): the row's columns in one, so that no name of theirs can clash; base spans; all spans. Both sorted by start, then kind, then end."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).cast("string").alias("text"))
    out = out.select("row", _ordered(base_spans(text)).alias("base"), F.filter(_located(text, CANDIDATE), lambda x: x["v"].rlike("[0-9]")).alias("suspect"))
    # the allow-list is located once a candidate, not once a window
    known = lambda v: F.concat(F.array().cast("array<struct<start:int,end:int,v:string>>"), *[_located(v, p) for p in allowed])
    out = out.select("row", "base", F.transform("suspect", lambda x: F.struct(x["start"], x["v"], known(x["v"]).alias("spared"))).alias("suspect"))
    out = out.select("row", "base", F.flatten(F.transform("suspect", lambda x: _windows(x["v"], x["start"], x["spared"]))).alias("more"))
    return out.select("row", "base", F.when(F.size("more") == 0, F.col("base")).otherwise(_ordered(F.concat("base", "more"))).alias("spans"))


def scan(docs: DataFrame, text_col: str = "text", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """docs with _base and _spans: base spans, and all spans, each sorted by start, then kind, then end. Input columns of these two names give way."""
    kept = [c for c in docs.columns if c not in ("_base", "_spans")]
    return _found(docs.select(*kept), text_col, allowed).select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("base").alias("_base"), F.col("spans").alias("_spans"))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span (sorted by start) replaced by MARK; spans that overlap count as one.

    The text is cut into chunks, and each chunk's spans are the next ones in order, so the cost stays in proportion to
    the text however many spans it has.
    """

    def merged(own: Column) -> Column:
        """Disjoint spans (start, end): a span opens one if it starts at or after the end of all before it."""
        reach = scanned(F.transform(own, lambda x: x["end"]), lambda a, b: F.greatest(a, b), F.lit(0))
        both = F.zip_with(own, reach, lambda x, end: F.struct(x["start"].alias("start"), end.alias("end")))
        return bound(both, lambda items: F.zip_with(*_grouped(items, lambda x, was: x["start"] < was["end"]), lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end"))))

    def rewritten(own: Column) -> Column:
        chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))

        def chunk(acc: Column, part: Column) -> Column:
            low, high = acc["low"], acc["low"] + CHUNK
            here = F.filter(F.slice(own, acc["next"] + 1, F.lit(CHUNK + 1)), lambda x: x["start"] < high)

            def lines(x: Column) -> Column:
                # what stands before each span here, then the mark if it begins here
                before = lambda i: F.greatest(F.lit(0), F.coalesce(F.get(x, i - 1)["end"], F.lit(0)) - low)
                pieces = F.transform(x, lambda s, i: F.when(s["start"] >= low, F.concat(F.substring(part, before(i) + 1, s["start"] - low - before(i)), F.lit(MARK))).otherwise(""))
                rest = F.substring(part, before(F.size(x)) + 1, F.lit(CHUNK))
                ended = F.size(F.filter(x, lambda s: s["end"] <= high))
                return F.struct(high.alias("low"), (acc["next"] + ended).alias("next"), F.concat(acc["out"], F.array(F.concat(F.array_join(pieces, ""), rest))).alias("out"))

            return bound(here, lines)

        start = F.struct(F.lit(0).alias("low"), F.lit(0).alias("next"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(chunks, start, chunk, lambda acc: F.array_join(acc["out"], ""))

    return F.when(F.size(spans) == 0, text).otherwise(bound(bound(spans, merged), rewritten))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("_base", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(F.col("_base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("_spans")).alias("spans"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, its secrets replaced by MARK; n_chars follows the text. Null texts stay null; columns of any name keep theirs."""
    found = _found(docs, "text").select("row", F.col("spans").alias("found"))
    found = found.select("row", "found", redacted(F.col("row.text"), F.col("found")).alias("text"))
    n_chars = F.when(F.size("found") == 0, F.col("row.n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return found.select(*[{"text": F.col("text"), "n_chars": n_chars}.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
