"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

Everything is built from native functions.  A pattern's matches come from
``regexp_extract_all`` and their places from the lengths of what ``split`` leaves
between them.

Candidates are runs of token characters.  For each, a window slides over the
run; counts of its characters are updated by the one that enters and the one that
leaves, and with them the sum of n*log2(n) (in fixed point, so no error builds
up), which gives the window's Shannon entropy.  A candidate's character class
sets the entropy that a window must reach; what reaching windows cover is a span.
Allow-listed candidates (whole-run patterns) and those that a pattern's match
touches are suppressed; with ``pieces``, only what the match covers is, and what it
leaves of a candidate on either side is measured as a candidate of its own.

All steps are linear in a text's length and in the number of its matches: a run
becomes an array of characters once, candidates and matches meet in one sorted
walk, and a text is redacted from blocks.

Defined results: a null text is read as empty; a text without secrets has zero
counts and empty spans; places are code points, ends exclusive; repeated rows are
independent; other columns pass through untouched, but an input column named
``secret_spans`` is replaced.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import named_again, numbered, text_of

#: Kind, pattern, capture group that is measured, least length of it.
PATTERNS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
#: Long runs only can pass, so their shorter kin need not be listed: the same matches, found faster.
FAST = {"hex": r"[0-9a-f]{24,}", "access": r"AKIA[A-Z0-9]{16,}"}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW
#: Class, pattern of the whole candidate, bits a character that a window must reach; the first that fits holds.
CLASSES = [
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", 3.0),
    ("upper", r"^[A-Z0-9]+$", 3.4),
    ("letters", r"^[A-Za-z]+$", 4.1),
    ("mixed", r"^.*$", 3.7),
]
#: Whole candidates that are never secrets: numbers, rules and separators, plain words joined by hyphens or slashes.
#: (Possessive, so the matcher keeps no stack for each word of a long run.)
ALLOWED = [r"^[0-9+/_=-]++$", r"^[+/_=-]*+[A-Za-z]?[a-z]++(?:[+/_=-]++[A-Za-z]?[a-z]*+)*+$", r"^[A-Z]++$"]
KINDS = [k for k, *_ in PATTERNS] + ["entropy"]
_UNIT = 10**9
_BLOCK = 256
_P = "__scan_"
_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _walk(items: Column, state: Column, out_type: str, step) -> Column:
    """The array of what ``step(state, item, index)`` puts out, as struct(state, out); block by block, so long lists stay cheap to add to."""
    block = F.lit(_BLOCK)

    def upto(base: Column, first: Column, count: Column) -> Column:
        zero = F.struct(base.alias("state"), F.array().cast(f"array<{out_type}>").alias("out"))
        add = lambda s, i: _once(step(s["state"], F.get(items, i), i), lambda r: F.struct(r["state"].alias("state"), F.concat(s["out"], F.array(r["out"])).alias("out")))
        return F.aggregate(F.sequence(first, first + count - 1), zero, add)

    n = F.size(items)
    whole = F.aggregate(
        F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")),
        F.struct(state.alias("state"), F.array().cast(f"array<array<{out_type}>>").alias("out")),
        lambda s, b: _once(upto(s["state"], b * block, F.least(block, n - b * block)), lambda u: F.struct(u["state"].alias("state"), F.concat(s["out"], F.array(u["out"])).alias("out"))),
    )
    return F.when(n > 0, F.flatten(whole["out"])).otherwise(F.array().cast(f"array<{out_type}>"))


def _starts(gaps: Column, hits: Column) -> Column:
    """Start of each hit, from the texts between hits."""

    def step(at: Column, hit: Column, i: Column) -> Column:
        start = at + F.length(F.get(gaps, i))
        return F.struct((start + F.length(hit)).alias("state"), start.alias("out"))

    return _walk(hits, F.lit(0), "int", step)


def _with_spans(df: DataFrame, text: Column, name: str, pattern: str, group: int, least: int, kind: int) -> DataFrame:
    """Adds ``name``: the pattern's spans whose measured group is long enough."""
    hits, sized, gaps = (F.col(_P + name + x) for x in ("_hits", "_sized", "_gaps"))
    df = df.withColumn(_P + name + "_hits", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    some = F.size(hits) > 0
    df = df.withColumns(
        {
            _P + name + "_gaps": F.when(some, F.split(text, pattern, -1)),
            _P + name + "_sized": F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))) if group else hits,
        }
    )
    df = df.withColumn(_P + name + "_starts", F.when(some, _starts(gaps, hits)))
    starts = F.col(_P + name + "_starts")
    spans = F.transform(starts, lambda s, i: F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + F.length(F.get(hits, i))).alias("end"), F.length(F.get(sized, i)).alias("size"), F.get(hits, i).alias("text")))
    return df.withColumn(_P + name, F.coalesce(F.filter(spans, lambda s: s["size"] >= least), F.filter(F.array(F.struct(F.lit(0).alias("start"), F.lit(kind).alias("kind"), F.lit(0).alias("end"), F.lit(0).alias("size"), F.lit("").alias("text"))), lambda s: F.lit(False))))


#: Counts of a window's characters stand in longs, five bits each.
_BITS, _IN_LONG = 5, 12


def entropy_span(run: Column, needed: Column, window: int = WINDOW) -> Column:
    """struct(first, last) of what the windows of ``needed`` (fixed-point bits a character) or more cover; first < 0: none."""
    if window >= 1 << _BITS:
        raise ValueError(f"a window has fewer than {1 << _BITS} characters")
    g = F.array(*[F.lit(round(n * log2(n) * _UNIT) if n else 0).cast("long") for n in range(window + 1)])
    most = F.lit(round(window * log2(window) * _UNIT)).cast("long")
    units = F.array(*[F.lit(1 << _BITS * (p % _IN_LONG)).cast("long") for p in range(len(ALPHABET))])

    def count(counts: Column, p: Column) -> Column:
        held = F.call_function("div", F.get(counts, F.call_function("div", p, F.lit(_IN_LONG)).cast("int")), F.get(units, p))
        return held.bitwiseAND(F.lit((1 << _BITS) - 1).cast("long")).cast("int")

    def step(known: Column, s: Column, i: Column) -> Column:
        places = known["places"]
        come, go = F.get(places, i), F.when(i >= window, F.get(places, i - window)).otherwise(F.lit(-1))
        entering = F.struct(come.alias("come"), go.alias("go"), count(s["counts"], come).alias("held"), F.when(go >= 0, count(s["counts"], go)).otherwise(0).alias("left"))
        return _once(entering, lambda e: moved(known, s, i, e))

    def moved(known: Column, s: Column, i: Column, e: Column) -> Column:
        # what leaves goes first; an equal character that enters then finds the lower count: nothing changes
        change = F.get(g, e["held"] + 1) - F.get(g, e["held"]) - F.when(e["left"] > 0, F.get(g, e["left"]) - F.get(g, e["left"] - 1)).otherwise(F.lit(0).cast("long"))
        return _once(s["sum"] + F.when(e["come"] == e["go"], F.lit(0).cast("long")).otherwise(change), lambda total: after(known, s, i, e, total))

    def after(known: Column, s: Column, i: Column, e: Column, total: Column) -> Column:
        word = lambda p: F.call_function("div", p, F.lit(_IN_LONG))
        add = lambda k: F.when(k == word(e["come"]), F.get(units, e["come"])).otherwise(0)
        take = lambda k: F.when((e["go"] >= 0) & (k == word(e["go"])), F.get(units, e["go"])).otherwise(0)
        reaches = (i >= window - 1) & ((most - total) >= known["needed"])
        return F.struct(
            F.when(e["come"] == e["go"], s["counts"]).otherwise(F.transform(s["counts"], lambda c, k: c + add(k) - take(k))).alias("counts"),
            total.alias("sum"),
            F.when(reaches & (s["first"] < 0), i - (window - 1)).otherwise(s["first"]).alias("first"),
            F.when(reaches, i + 1).otherwise(s["last"]).alias("last"),
        )

    none = F.array_repeat(F.lit(0).cast("long"), -(-len(ALPHABET) // _IN_LONG))
    zero = F.struct(none.alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    places = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    # Both look at the whole run, so they are computed once for it and not at every step.
    once = F.struct(places.alias("places"), (needed * window).alias("needed"), F.length(run).alias("n"))
    return _once(once, lambda known: F.aggregate(F.sequence(F.lit(0), known["n"] - 1), zero, lambda s, i: step(known, s, i), lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"))))


def _needed(run: Column) -> Column:
    out = None
    for _, pattern, bits in CLASSES:
        value = F.lit(round(bits * _UNIT)).cast("long")
        out = F.when(run.rlike(pattern), value) if out is None else out.when(run.rlike(pattern), value)
    return out


def _left(base: Column, candidates: Column) -> Column:
    """struct(of, start, end) of what the matches leave of the candidates (``of`` counts them), where a window or more.

    One walk over both by start.  The state is the current candidate, where its uncovered part begins, and its end.
    """
    event = "struct<start:int,is_match:boolean,end:int,of:int>"
    marks = F.concat(
        F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(True).alias("is_match"), b["end"].alias("end"), F.lit(-1).alias("of")).cast(event)),
        F.transform(candidates, lambda c, i: F.struct(c["start"].alias("start"), F.lit(False).alias("is_match"), c["end"].alias("end"), i.alias("of")).cast(event)),
        # A last candidate after all others closes the one before it.
        F.array(F.struct(F.lit(2**31 - 1).alias("start"), F.lit(False).alias("is_match"), F.lit(2**31 - 1).alias("end"), F.lit(-1).alias("of")).cast(event)),
    )
    piece, state = "struct<of:int,start:int,end:int>", "struct<of:int,at:int,end:int,covered:int>"

    def step(s: Column, e: Column, i: Column) -> Column:
        upto = F.when(e["is_match"], F.least(e["start"], s["end"])).otherwise(s["end"])
        out = F.struct(s["of"].alias("of"), s["at"].alias("start"), upto.alias("end")).cast(piece)
        covered = F.when(e["is_match"], F.greatest(s["covered"], e["end"])).otherwise(s["covered"])
        moved = F.when(e["is_match"], F.struct(s["of"].alias("of"), F.greatest(s["at"], e["end"]).alias("at"), s["end"].alias("end"), covered.alias("covered")).cast(state)).otherwise(
            F.struct(e["of"].alias("of"), F.greatest(e["start"], covered).alias("at"), e["end"].alias("end"), covered.alias("covered")).cast(state)
        )
        return F.struct(moved.alias("state"), out.alias("out"))

    none = F.struct(F.lit(-1).alias("of"), F.lit(0).alias("at"), F.lit(0).alias("end"), F.lit(0).alias("covered")).cast(state)
    found = _once(F.array_sort(marks), lambda sorted_: _walk(sorted_, none, piece, step))
    return F.filter(found, lambda p: (p["of"] >= 0) & (p["end"] - p["start"] >= WINDOW))


def scan(df: DataFrame, text_col: str = "text", allowed: list[str] | None = None, pieces: bool = False) -> DataFrame:
    """``df`` with ``secret_spans``: array of (start, kind, end), by start, then kind (a number into ``KINDS``)."""
    text, names = F.col(_P + "text"), df.columns
    out = numbered(df).withColumn(_P + "text", text_of(f"in_{names.index(text_col)}"))
    for kind, (name, pattern, group, least) in enumerate(PATTERNS):
        out = _with_spans(out, text, name, FAST.get(name, pattern), group, least, kind)
    out = _with_spans(out, text, "entropy", CANDIDATE, 0, WINDOW, len(PATTERNS))

    def plain(name: str) -> Column:
        return F.transform(F.col(_P + name), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    out = out.withColumn(_P + "base", F.concat(*(plain(name) for name, *_ in PATTERNS)))

    def listed_as_plain(c: Column) -> Column:
        hit = F.lit(False)
        for pattern in ALLOWED if allowed is None else allowed:
            hit = hit | c["text"].rlike(pattern)
        return hit

    out = out.withColumn(_P + "open", F.filter(F.col(_P + "entropy"), lambda c: ~listed_as_plain(c)))
    base, open_ = F.col(_P + "base"), F.col(_P + "open")
    some = (F.size(base) > 0) & (F.size(open_) > 0)
    out = out.withColumn(_P + "left", F.when(some, _left(base, open_)))
    left = F.col(_P + "left")
    if pieces:
        # Candidates are ASCII, so their bytes are cut in constant time.
        cut = F.transform(left, lambda p: F.struct(p["start"].alias("start"), F.substring(F.get(open_, p["of"])["text"].cast("binary"), p["start"] - F.get(open_, p["of"])["start"] + 1, p["end"] - p["start"]).cast("string").alias("text")))
        alone = F.transform(open_, lambda c: F.struct(c["start"].alias("start"), c["text"].alias("text")))
        out = out.withColumn(_P + "pieces", F.when(some, F.filter(cut, lambda c: ~listed_as_plain(c))).otherwise(alone))
    else:
        whole = F.filter(left, lambda p: (p["start"] == F.get(open_, p["of"])["start"]) & (p["end"] == F.get(open_, p["of"])["end"]))
        out = out.withColumn(_P + "pieces", F.when(some, F.transform(whole, lambda p: F.get(open_, p["of"]))).otherwise(open_))
    measured = F.transform(F.col(_P + "pieces"), lambda c: F.struct(c["start"].alias("at"), entropy_span(c["text"], _needed(c["text"])).alias("w")))
    out = out.withColumn(_P + "measured", measured)
    reached = F.filter(F.col(_P + "measured"), lambda m: m["w"]["first"] >= 0)
    added = F.transform(reached, lambda m: F.struct((m["at"] + m["w"]["first"]).alias("start"), F.lit(len(PATTERNS)).alias("kind"), (m["at"] + m["w"]["last"]).alias("end")))
    out = out.withColumn("secret_spans", F.array_sort(F.concat(base.cast(_SPAN), added.cast(_SPAN))))
    return out.select(*named_again(names, "secret_spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Characters of a block that a text is cut into to be redacted.
_CUT = 4096


def redacted(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with each span (overlapping ones as one) replaced by ``mark``."""

    def between(blocks: Column, start: Column, end: Column) -> Column:
        """The characters from ``start`` up to ``end``, from the blocks that hold them."""
        first, last = F.floor(start / _CUT).cast("int"), F.floor(end / _CUT).cast("int")
        inner = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        apart = F.concat(F.substring(F.get(blocks, first), start % _CUT + 1, F.lit(_CUT)), inner, F.coalesce(F.substring(F.get(blocks, last), F.lit(1), end % _CUT), F.lit("")))
        return F.when(end <= start, F.lit("")).when(first == last, F.substring(F.get(blocks, first), start % _CUT + 1, end - start)).otherwise(apart)

    def step(blocks: Column):
        def one(at: Column, x: Column, i: Column) -> Column:
            piece = F.when(x["start"] >= at, F.concat(between(blocks, at, x["start"]), F.lit(mark))).otherwise(F.lit(""))
            return F.struct(F.greatest(at, x["end"]).alias("state"), piece.alias("out"))

        return one

    def rest(blocks: Column) -> Column:
        return between(blocks, F.array_max(F.transform(spans, lambda x: x["end"])), F.length(text))

    cut = F.regexp_extract_all(text, F.lit(r"(?s).{1,%d}" % _CUT), F.lit(0))
    joined = _once(cut, lambda blocks: F.concat(F.array_join(_walk(spans, F.lit(0), "string", step(blocks)), ""), rest(blocks)))
    return F.when(F.size(spans) > 0, joined).otherwise(text)
