"""Citation extraction inside one row: arrays in, arrays out, no shuffle.

A document's citations are bounded by its own text, so carrying a law name forward,
filtering and ordered de-duplication run as array folds where the text already is.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import constants as K
from .text import any_of, blank_to_null, drop_space, let, strip

_PAIRS = "array<struct<law:string,art:string>>"


def _in(c: Column, words) -> Column:
    return c.isin(*words)


def _contains(c: Column, words) -> Column:
    return c.rlike(any_of(words))


def find_articles(text: Column, head: int | None = None) -> Column:
    """Ordered ``struct(between, art)``: each article and the text that precedes it."""
    sample = strip(F.substring(text, 1, head) if head else text)

    def found(s):
        zipped = F.zip_with(
            F.split(s, K.ARTICLE, -1),
            F.regexp_extract_all(s, F.lit(K.ARTICLE), F.lit(0)),
            lambda p, a: F.struct(strip(p).alias("between"), drop_space(a).alias("art")),
        )
        return F.filter(zipped, lambda x: x["art"].isNotNull())

    return let(sample, found)


# A name that reaches the end starts where its run of characters starts; saying so lets the search
# skip every position inside a run and does not change what is found.
_RUN_START = f"(?<![{K.LAW_CHARS}])"

# Names are looked for at the end of a text, so only its tail is searched: what follows the closing bracket before the last where a
# bracket ends it, else its last runs of name characters, as far as colons join them. The tail is found from behind, in the reversed
# text, where the marker stands for the beginning: a tail with nothing but junk before it has its junk trimmed too.
_MARKER = "\x02"
_JUNK = f"[{K.EDGE_JUNK_MARKS}{K.WS_CLASS}]"
_TAIL = (
    rf"^{_JUNK}*+(」[^」]*+|[{K.LAW_CHARS}]++(?:{K.S}++:[{K.LAW_CHARS}]++)*+(?:{_JUNK}*+{_MARKER}\z)?)"
)


def _unwrap(between: Column) -> Column:
    """Without parentheses and without the junk characters at either end, as far back as a name can reach."""
    bare = F.regexp_replace(between, K.PARENTHESES, "")
    tail = F.reverse(F.regexp_extract(F.reverse(F.concat(F.lit(_MARKER), bare)), _TAIL, 1))
    junk = K.EDGE_JUNK_MARKS + K.WS_CHARS
    return let(tail, lambda t: F.when(t.startswith(_MARKER), F.btrim(F.substring(t, 2, 2**31 - 1), F.lit(junk))).otherwise(t))


def _candidates(c: Column) -> Column:
    return F.struct(
        F.when(c.endswith("」"), strip(F.regexp_extract(c, K.BRACKETED_LAW, 1))).otherwise("").alias("quoted"),
        F.regexp_extract(c, _RUN_START + K.COMPOUND_LAW, 1).alias("compound"),
        F.regexp_extract(c, _RUN_START + K.WORD_LAW, 1).alias("word"),
    )


def _best(x: Column) -> Column:
    usable = lambda w: (w != "") & ~_in(w, K.LAW_STOP_WORDS)
    return (
        F.when(x["quoted"] != "", x["quoted"])
        .when(usable(x["compound"]), x["compound"])
        .when(usable(x["word"]), x["word"])
        .otherwise("")
    )


def law_before(between: Column) -> Column:
    """Best law name that ends the text before an article, or the empty string."""
    return let(let(_unwrap(between), _candidates), _best)


def is_valid_law(law: Column) -> Column:
    return (law != "") & ~law.rlike(K.SUBUNIT_ONLY) & ~_contains(law, K.INVALID_LAW_KEYWORDS)


def keep_valid_law(law: Column) -> Column:
    return let(law, lambda w: F.when(is_valid_law(w), w).otherwise(""))


def law_article_pairs(text: Column, head: int | None = None) -> Column:
    return F.transform(
        find_articles(text, head),
        lambda x: F.struct(keep_valid_law(law_before(x["between"])).alias("law"), x["art"].alias("art")),
    )


def _unnamed(law: Column, words) -> Column:
    return (law == "") | _in(law, words) | law.startswith("제") | law.rlike(K.INCOMPLETE_LAW)


def inherit_law(pairs: Column) -> Column:
    """Give bare and subordinate references the last complete law seen before them.

    The complete laws cut the list into stretches that share one law, so every pair is visited once.
    """
    suffix = lambda law: _in(law, K.SUFFIX_LAWS)
    bare = lambda law: _in(law, K.STANDALONE_LAWS) | _unnamed(law, K.INCOMPLETE_WORDS)

    def named(pair, main):
        law = pair["law"]
        full = (
            F.when((main != "") & suffix(law), F.concat(main, F.lit(" "), strip(F.replace(law, F.lit("동법"), F.lit("")))))
            .when((main != "") & bare(law), main)
            .otherwise(law)
        )
        return F.struct(full.alias("law"), pair["art"].alias("art"))

    def stretches(ps):
        marked = F.transform(ps, lambda p, i: F.struct(
            (i + 1).alias("end"), p["law"].alias("law"),
            (~suffix(p["law"]) & ~bare(p["law"]) & ~_contains(p["law"], K.SUBORDINATE_MARKS)).alias("main"),
        ))
        start = F.array(F.struct(F.lit(0).alias("end"), F.lit("").alias("law"), F.lit(True).alias("main")))
        mains = F.concat(start, F.filter(marked, lambda m: m["main"]))
        return F.struct(ps.alias("ps"), mains.alias("mains"))

    def spread(x):
        upto = lambda i: F.coalesce(F.get(x["mains"], i + 1)["end"], F.size(x["ps"]))
        return F.flatten(F.transform(x["mains"], lambda m, i: F.transform(
            F.slice(x["ps"], m["end"] + 1, upto(i) - m["end"]), lambda p: named(p, m["law"])
        )))

    return let(let(pairs, stretches), spread).cast(_PAIRS)


def filter_citations(pairs: Column) -> Column:
    """``struct(laws, citations)`` of ordered distinct values; bare articles survive only on their own."""

    def split(x):
        laws = F.array_distinct(F.transform(x["full"], lambda p: p["law"]))
        qualified = F.transform(x["full"], lambda p: F.concat_ws(" ", p["law"], p["art"]))
        bare = F.transform(x["pairs"], lambda p: p["art"])
        return F.struct(
            laws.alias("laws"),
            F.array_distinct(F.when(F.size(x["full"]) > 0, qualified).otherwise(bare)).alias("citations"),
        )

    full = lambda ps: F.filter(ps, lambda p: ~_unnamed(p["law"], K.BARE_CITATION_WORDS))
    return let(let(pairs, lambda ps: F.struct(ps.alias("pairs"), full(ps).alias("full"))), split)


def legal_metadata(text: Column, head: int | None = None) -> Column:
    """``struct(laws, citations)`` of a text, comma-joined."""
    found = filter_citations(inherit_law(law_article_pairs(text, head)))
    return let(found, lambda f: F.struct(
        F.array_join(f["laws"], ", ").alias("laws"), F.array_join(f["citations"], ", ").alias("citations")
    ))


def post_clean(joined: Column, strict: bool = False) -> Column:
    """Second pass over a comma-joined list: trim pointer words, keep law-like items.

    ``strict`` tests the first token only, which loses laws whose name has a space;
    the default tests the whole name before the article.
    """
    items = F.transform(F.split(F.coalesce(joined, F.lit("")), ",", -1), strip)

    def trimmed(item):
        lead = blank_to_null(strip(F.regexp_extract(item, K.LEADING_CITATION, 1)))
        return F.when(_contains(item, K.POINTER_WORDS), lead).otherwise(item)

    def kept(item):
        if strict:
            name = F.regexp_extract(item, f"^[^{K.WS_CLASS}]+", 0)
        else:
            name = strip(F.regexp_replace(item, f"{K.S}제{K.D}+조(?:의{K.D}+)?$", ""))
        return item.isNotNull() & (item != "") & (name.rlike(K.VALID_LAW_SUFFIX) | item.rlike(K.ARTICLE_START))

    return F.array_join(F.array_distinct(F.filter(F.transform(items, trimmed), kept)), ", ")


def law_name_candidates(text: Column, pattern: str = K.LAW_NAME_BODY) -> Column:
    regex = (
        rf"(?md)(?=[가-힣])(?:^|(?<={K.S}))(?:구{K.S}+)?({pattern}){K.LAW_NAME_PAREN}"
        rf"(?={K.S}*제{K.S}*{K.D}+{K.S}*조|{K.S}|$)"
    )
    names = F.transform(F.regexp_extract_all(text, F.lit(regex), F.lit(1)), strip)
    bad_end = any_of(K.NOT_LAW_SUFFIXES) + "$"
    return F.filter(names, lambda n: (n != "") & ~_in(n, K.NOT_LAW_NAMES) & ~n.rlike(bad_end))


def law_mode(text: Column, pattern: str = K.LAW_NAME_BODY) -> Column:
    """The law a text is about: its most frequent law name, the earliest on ties."""
    names = F.transform(law_name_candidates(text, pattern), lambda n, i: F.struct(n.alias("n"), i.alias("i")))

    def ranked(s):
        starts = _run_starts(s, "n")
        upto = lambda j: F.coalesce(F.get(starts, j + 1)["at"], F.size(s))
        return F.transform(starts, lambda r, j: F.struct((upto(j) - r["at"]).alias("c"), (-r["x"]["i"]).alias("p"), r["x"]["n"].alias("n")))

    return F.coalesce(F.array_max(let(F.array_sort(names), ranked))["n"], F.lit(""))


def _run_starts(ordered: Column, field: str) -> Column:
    """``struct(at, x)`` of every element of a sorted array whose field differs from the one before."""
    placed = F.transform(ordered, lambda x, i: F.struct(i.alias("at"), x.alias("x")))
    return F.filter(placed, lambda p: (p["at"] == 0) | (F.get(ordered, p["at"] - 1)[field] != p["x"][field]))


def law_refs(text: Column, pattern: str = K.LAW_REF) -> Column:
    """Ordered law references of a text, one per spelling-free form, first spelling kept."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))

    keyed = F.transform(found, lambda r, i: F.struct(drop_space(r).alias("key"), i.alias("at"), r.alias("ref")))
    firsts = let(F.array_sort(keyed), lambda s: F.transform(_run_starts(s, "key"), lambda r: F.struct(r["x"]["at"].alias("at"), r["x"]["ref"].alias("ref"))))
    return F.transform(F.array_sort(firsts), lambda r: r["ref"])


def article_header(section: Column) -> Column:
    """Article number when a section opens with a titled article, else the empty string."""
    head = F.regexp_extract(section, f"^({K.SECTION_HEAD}){K.SECTION_TITLE}", 1)
    return drop_space(head)


def with_law(law: Column, article: Column) -> Column:
    return F.when(article == "", F.lit("")).otherwise(F.concat_ws(" ", blank_to_null(law), article))
