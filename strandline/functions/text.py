"""Normalisation of names, codes and flags as column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of share classes and of legal forms that are taken off the end of an issuer's name.
SHARE_WORDS = ("a", "b", "c", "d", "ord", "ordinary", "pref", "preference", "series", "ser", "share", "shares")
LEGAL_WORDS = ("ab", "abp", "asa", "oy", "oyj", "as", "aps", "plc", "nv", "sa", "ag", "ltd", "limited")
#: Words that a company key leaves out.
NOISE_WORDS = ("a", "b", "c", "d", "series", "share", "shares", "sdb", "sek", "dkk", "ab", "abp", "asa", "oy", "oyj", "as", "aps", "plc", "ltd", "limited", "hf")
#: Endings of codes, and parts of names (between blanks), that aren't common shares.
OTHER_CODES = ("-tr", "-ur", "-sr", "-il", "-bta", "-btu", "-to", "-wrt", "-unit", "-spac", "-me", "-pref")
OTHER_NAMES = (
    " fund", " etf", "warrant", "certifikat", "certificate", "mini future", "subscription right", "teckningsratt", "teckningsr\u00e4tt", "preferens", "preferred",
    "depository receipt", "adr", "gdr", "spac", "bond", "obligation", "rights", " bevis",
)
#: What in "code name" tells a share class, in order.
CLASSES = {
    "preferred": (" preferred", " preferens", " pref"),
    "rights": (" right", " rights", " teckningsr", "-tr", "-ur", "-sr"),
    "depositary": (" adr", " gdr", "depository receipt"),
}
#: The type that names without one are taken to have.
COMMON = "common stock"


def clean(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def flag(c: Column, blank: bool) -> Column:
    """Boolean of a text; anything but the usual words is an error."""
    low = F.lower(clean(c))
    return (
        F.when(low == "", F.lit(blank)).when(low.isin("1", "true", "yes", "y"), F.lit(True)).when(low.isin("0", "false", "no", "n"), F.lit(False))
        .otherwise(F.raise_error(F.concat(F.lit("not a flag: "), low)).cast("boolean"))
    )


def exchange_code(c: Column) -> Column:
    """After the last dot, upper case; empty without one."""
    return F.when(F.instr(c, ".") > 0, F.upper(F.substring_index(c, ".", -1))).otherwise("")


def stem(c: Column) -> Column:
    return F.substring_index(c, ".", 1)


def symbol_key(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), r"[^\p{L}\p{N}]", "")


@cache
def _folds() -> dict[str, str]:
    """What every character beyond ASCII decomposes into (NFKD), as far as that is ASCII; those of which nothing is left aren't there."""
    out = {}
    for code in range(128, 0x110000):
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode() if not 0xD800 <= code < 0xE000 else ""
        if plain:
            out[chr(code)] = plain
    return out


def _class(characters: list[str]) -> str:
    """A regular expression for one of these, as runs of code points."""
    codes, runs = sorted(map(ord, characters)), []
    for c in codes:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs)


def folded(c: Column) -> Column:
    """Compatibility-decomposed and without anything beyond ASCII: marks, and letters that have no plain form, are left out.

    A lookup over characters. Those that stand for several (ligatures, fractions, units) are spelled place by place, in texts that have one.
    """
    one = {k: v for k, v in _folds().items() if len(v) == 1}
    several = {k: v for k, v in _folds().items() if len(v) > 1}
    own = _class(list(several))

    def spelled(x: Column) -> Column:
        alone = F.regexp_replace(x, f"[^{own}]", "")  # empty for any other character
        places = [
            F.translate(F.regexp_replace(alone, f"[^{_class(some)}]", ""), "".join(some), "".join(several[ch][k] for ch in some))
            for k in range(max(map(len, several.values())))
            if (some := [ch for ch, v in several.items() if len(v) > k])
        ]
        return F.when(alone == "", x).otherwise(F.concat(*places))

    text = clean(c)
    text = F.when(text.rlike(f"[{own}]"), F.array_join(F.transform(F.split(text, ""), spelled), "")).otherwise(text)
    return F.regexp_replace(F.translate(text, "".join(one), "".join(one.values())), r"[^\x00-\x7F]", "")


def company_key(c: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(folded(c)), r"[^a-z0-9]+", " "), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*NOISE_WORDS)), " ")


def issuer_group(c: Column) -> Column:
    """Name without brackets and trailing share-class, then legal, words, joined by dashes; the whole name if nothing is left."""
    low = F.lower(F.replace(folded(c), F.lit("&"), F.lit(" and ")))
    dashed = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, r"\([^)]*\)", " "), r"[^a-z0-9]+", "-"), r"^-|-$", "")
    bare = reduce(lambda x, own: F.regexp_replace(x, f"(^|-)({'|'.join(own)})(-({'|'.join(own)}))*$", ""), (SHARE_WORDS, LEGAL_WORDS), dashed)
    return F.when(bare != "", bare).when(dashed != "", dashed).otherwise(clean(c))


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda x, part: x | text.contains(part), parts[1:], text.contains(parts[0]))


def security_type(name: Column, code: Column | None = None, raw: Column | None = None) -> Column:
    """fund, etf, common_share or other, by the raw type (common stock where there is none to ask), then the name, then the code's ending."""
    kind = F.lower(clean(raw)) if raw is not None else F.lit(COMMON)
    padded, ticker = F.concat(F.lit(" "), F.lower(clean(name)), F.lit(" ")), F.lower(clean(code)) if code is not None else F.lit("")
    odd = reduce(lambda x, end: x | ticker.endswith(end), OTHER_CODES[1:], ticker.endswith(OTHER_CODES[0]))
    return F.when(kind.contains("fund"), "fund").when(kind.contains("etf"), "etf").when(~kind.contains(COMMON) | _any(padded, OTHER_NAMES) | odd, "other").otherwise("common_share")


def share_class(name: Column, code: Column | None = None) -> Column:
    both = F.lower(F.concat(clean(code) if code is not None else F.lit(""), F.lit(" "), clean(name)))
    out = F.lit("ordinary")
    for kind, parts in reversed(CLASSES.items()):
        out = F.when(_any(both, parts), kind).otherwise(out)
    return out


# The same two in SQL, of expressions that are text.
def type_sql(name: str, code: str = "''") -> str:
    padded = f"' ' || lower(trim(coalesce({name}, ''))) || ' '"
    tests = [f"contains({padded}, '{part}')" for part in OTHER_NAMES] + [f"ends_with(lower(trim(coalesce({code}, ''))), '{end}')" for end in OTHER_CODES]
    return f"case when {' or '.join(tests)} then 'other' else 'common_share' end"


def class_sql(name: str, code: str = "''") -> str:
    both = f"lower(trim(coalesce({code}, '')) || ' ' || trim(coalesce({name}, '')))"
    return "case " + " ".join(f"when {' or '.join(f"contains({both}, '{part}')" for part in parts)} then '{kind}'" for kind, parts in CLASSES.items()) + " else 'ordinary' end"


def finite(c: Column) -> Column:
    """The number, or null if it is not finite."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def candidate_parts(c: Column) -> Column:
    """lookback, skip, top_n and strategy of a candidate's name; null if it isn't one."""
    pattern = r"^l(\d+)_s(\d+)_n(\d+)_strat=(.+)$"
    parts = [F.regexp_extract(c, pattern, k + 1) for k in range(4)]
    numbers = [p.try_cast("int").alias(n) for p, n in zip(parts, ("lookback", "skip", "top_n"), strict=False)]
    return F.when(c.rlike(pattern), F.struct(*numbers, parts[3].alias("strategy")))


def split_ratio(c: Column) -> tuple[Column, Column]:
    """Ratio of ``n/d`` and its kind."""
    parts = F.split(c, "/")
    ratio = F.try_divide(parts[0].try_cast("double"), F.get(parts, F.lit(1)).try_cast("double"))
    return ratio, F.when(ratio >= 1, "split").when(ratio.isNotNull(), "reverse_split")


def candidate_id(lookback: Column, skip: Column, top_n: Column, strategy: Column) -> Column:
    return F.format_string("l%d_s%d_n%d_strat=%s", lookback, skip, top_n, strategy)
