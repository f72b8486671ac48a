"""String column expressions: keys, cleaning, dialogue text, parsing, labels.

All are built-in Spark expressions (Column -> Column), so they stay inside
whole-stage code generation.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnscore import schemas as S

# Whitespace removed by Python's str.strip() on ASCII text.
_WS = "[ \\t\\n\\r\\f\\x0B]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def base_name(path) -> Column:
    """Last path component."""
    return F.element_at(F.split(_c(path), "/"), -1)


def subject_key(name) -> Column:
    """Subject code = first two '_' parts of a file name (``MC_1234_MADRS.mp4`` -> ``MC_1234``)."""
    return F.substring_index(base_name(name), "_", 2)


def subject_key_parts(name, start: int = 2, count: int = 3) -> Column:
    """Variant key: ``count`` '_' parts starting at 1-based part ``start``
    (``f_MC_1234_MADRS.wav`` -> ``MC_1234_MADRS.wav``)."""
    return F.array_join(F.slice(F.split(base_name(name), "_"), start, count), "_")


def audio_name(subject) -> Column:
    return F.concat(_c(subject), F.lit("_MADRS.wav"))


def filtered_audio_name(file_name) -> Column:
    """``X.mp4`` -> ``f_X.wav``."""
    return F.concat(F.lit("f_"), F.replace(base_name(file_name), F.lit(".mp4"), F.lit(".wav")))


def seconds_to_ms(seconds) -> Column:
    """Seconds to integer milliseconds, truncating toward zero like ``int()``."""
    return (_c(seconds) * F.lit(1000.0)).cast("bigint")


def segment_key(subject, speaker, start_ms, end_ms) -> Column:
    """``{subject}_{speaker}_{start_ms}_{end_ms}.wav``."""
    return F.concat(F.concat_ws("_", _c(subject), _c(speaker), _c(start_ms).cast("string"),
                                _c(end_ms).cast("string")), F.lit(".wav"))


def clean_text(text) -> Column:
    """Null -> '', anything else -> its string form."""
    return F.coalesce(_c(text).cast("string"), F.lit(""))


def replace_phrases(text, phrases=None) -> Column:
    """Literal (substring) replacements applied in list order."""
    out = _c(text)
    for old, new in (phrases if phrases is not None else S.PHRASES):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def speaker_role(speaker) -> Column:
    """``SPEAKER_00`` -> Interviewer; every other label (null too) -> Patient."""
    return F.when(_c(speaker) == F.lit(S.INTERVIEWER_SPEAKER), F.lit("Interviewer")) \
        .otherwise(F.lit("Patient"))


def dialogue_line(role, text) -> Column:
    return F.concat(_c(role), F.lit(": "), _c(text))


def strip_ws(text) -> Column:
    """Python ``str.strip()`` for ASCII whitespace (leading, then trailing)."""
    return F.regexp_replace(F.regexp_replace(_c(text), f"^{_WS}+", ""), f"{_WS}+$", "")


def example_input(topic, dialogue_body) -> Column:
    """``Topic: {t} \\n`` + strip(``Dialogue:\\n`` + body) + ``\\n\\n``.

    ``dialogue_body`` is the '\\n'-joined dialogue lines; the line feed after the
    last line is removed by the strip anyway.
    """
    return F.concat(F.lit("Topic: "), _c(topic), F.lit(" \n"),
                    strip_ws(F.concat(F.lit("Dialogue:\n"), _c(dialogue_body))), F.lit("\n\n"))


def score_output(score) -> Column:
    """``Score: {score}`` with the float form of a DOUBLE score (4.0 -> '4.0')."""
    return F.concat(F.lit("Score: "), _c(score).cast("double").cast("string"))


def parse_topic(inp) -> Column:
    """First line minus ``Topic:``, stripped, when ``Topic:`` occurs anywhere; else Unknown."""
    first_line = F.substring_index(_c(inp), "\n", 1)
    return F.when(_c(inp).contains("Topic:"),
                  strip_ws(F.replace(first_line, F.lit("Topic:"), F.lit("")))) \
        .otherwise(F.lit(S.UNKNOWN_TOPIC))


def parse_score(output) -> Column:
    """Text between the first and second ':' -> float -> int (truncation)."""
    part = F.split_part(_c(output), F.lit(":"), F.lit(2))
    return strip_ws(part).try_cast("double").cast("int")


def is_synthetic(subject) -> Column:
    return _c(subject).endswith(S.SYNTHETIC_SUFFIX)


def fraction_label(fraction) -> Column:
    """``int(frac*100)%``."""
    return F.concat((_c(fraction) * F.lit(100.0)).cast("int").cast("string"), F.lit("%"))


def slug(name) -> Column:
    """Blanks -> '_', dots removed, lower case."""
    return F.lower(F.replace(F.replace(_c(name), F.lit(" "), F.lit("_")), F.lit("."), F.lit("")))


def p_display(p_adj) -> Column:
    return F.when(_c(p_adj) < F.lit(1e-4), F.lit("P < 0.0001")) \
        .when(_c(p_adj).isNotNull(), F.concat(F.lit("P = "), fixed(p_adj, 4)))


#: A fraction in fixed point: limbs of 28 bits; a double's bits beyond them only matter as a remainder.
_LIMB, _LIMBS = 1 << 28, 8
_GROUP = 7  # digits taken at once: a limb times 10**7 fits a long


def _limbs(fraction: Column) -> Column:
    """(limbs, rest): the binary digits of a fraction in [0, 1), exact, the most significant limb first."""
    def limb(acc, _):
        t = acc["rest"] * F.lit(float(_LIMB))
        return F.struct(F.array_append(acc["limbs"], F.floor(t).cast("bigint")).alias("limbs"), (t - F.floor(t)).alias("rest"))
    start = F.struct(F.expr("cast(array() as array<bigint>)").alias("limbs"), fraction.alias("rest"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(_LIMBS)), start, limb)


def _times(limbs: Column, power: Column) -> Column:
    """(limbs, carry) of a fraction times a power of ten: its next digits are the carry."""
    def one(acc, limb):
        v = limb * power + acc["carry"]
        return F.struct(F.concat(F.array(v % _LIMB), acc["limbs"]).alias("limbs"), F.floor(v / _LIMB).alias("carry"))
    start = F.struct(F.expr("cast(array() as array<bigint>)").alias("limbs"), F.lit(0).cast("bigint").alias("carry"))
    return F.aggregate(F.reverse(limbs), start, one)


def fixed(x, digits: int) -> Column:
    """A DOUBLE with ``digits`` (1 to 20) decimals, as C and Python print it: the exact binary value, rounded half
    to even. ``nan``, ``inf`` and ``-inf`` by name, null stays null, a negative zero keeps its sign. For
    magnitudes below 10**17.

    The fraction becomes limbs in fixed point, exactly; each group of digits is the carry of a
    multiplication by a power of ten, and what remains decides the rounding."""
    x = _c(x).cast("double")
    size = F.abs(x)
    whole = F.floor(size)
    powers = [_GROUP] * (digits // _GROUP) + [digits % _GROUP] * (digits % _GROUP > 0)
    powers = F.array(*[F.lit(10 ** p).cast("bigint") for p in powers])

    def group(acc, power):
        def take(t):
            return F.struct(t["limbs"].alias("limbs"), (acc["n"] * power.cast("decimal(8,0)") + t["carry"].cast("decimal(19,0)")).cast(
                "decimal(38,0)").alias("n"))
        return F.transform(F.array(_times(acc["limbs"], power)), take)[0]

    def text(r):
        """``r`` has the limbs that remain, the number without its point, and the bits beyond all limbs."""
        first, others = r["limbs"][0], F.exists(F.slice(r["limbs"], 2, _LIMBS), lambda v: v != 0) | (r["rest"] > 0)
        up = (first > _LIMB // 2) | ((first == _LIMB // 2) & (others | (r["n"] % 2 == 1)))
        n = F.lpad((r["n"] + F.when(up, F.lit(1)).otherwise(F.lit(0)).cast("decimal(1,0)")).cast("decimal(38,0)").cast("string"), 38, "0")
        return F.concat(F.coalesce(F.nullif(F.ltrim(F.substring(n, 1, 38 - digits), F.lit("0")), F.lit("")), F.lit("0")),
                        F.lit("."), F.substring(n, 39 - digits, digits))

    def digits_of(f):
        start = F.struct(f["limbs"].alias("limbs"), whole.cast("decimal(38,0)").alias("n"))
        return F.transform(F.array(F.aggregate(powers, start, group)),
                           lambda g: F.struct(g["limbs"].alias("limbs"), g["n"].alias("n"), f["rest"].alias("rest")))[0]

    number = F.transform(F.transform(F.array(_limbs(size - whole)), digits_of), text)[0]
    negative = (x < 0) | (x.cast("string") == "-0.0")
    return F.when(F.isnan(x), F.lit("nan")).when(size == F.lit(float("inf")), F.when(x > 0, F.lit("inf")).otherwise(F.lit("-inf"))) \
        .otherwise(F.concat(F.when(negative, F.lit("-")).otherwise(F.lit("")), number))


def formatted(template: str, *values) -> Column:
    """A template with ``%s``, ``%.Nf`` (``fixed``) and ``%%`` filled in; null if a value is."""
    parts, rest = [], [_c(v) for v in values]
    for piece in re.split(r"(%s|%\.\d+f|%%)", template):
        if piece == "%s":
            parts.append(rest.pop(0).cast("string"))
        elif re.fullmatch(r"%\.\d+f", piece):
            parts.append(fixed(rest.pop(0), int(piece[2:-1])))
        elif piece:
            parts.append(F.lit("%" if piece == "%%" else piece))
    return F.concat(*parts)


def side_name(name, side: int) -> Column:
    """Name of side 1 or 2 of ``A vs. B``."""
    return F.trim(F.split_part(_c(name), F.lit("vs."), F.lit(side)))
