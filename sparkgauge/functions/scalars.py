"""Null-safe arithmetic, text and display helpers, all as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stand-in for a zero divisor, and the largest time that is shown.
TINY_DIVISOR, LAST_SECOND = 1e-10, 2**31


def safe_divide(num: Column, den: Column, num_default: float = 0.0, den_default: float = 1.0) -> Column:
    d = F.coalesce(den.cast("double"), F.lit(den_default))
    return F.coalesce(num.cast("double"), F.lit(num_default)) / F.when(d == 0, TINY_DIVISOR).otherwise(d)


def safe_add(*xs: Column, signs: list[int] | None = None) -> Column:
    """Sum in which a null counts as zero; signs has 1 or -1 for each term."""
    signs = signs or [1] * len(xs)
    if len(signs) != len(xs):
        raise ValueError("as many signs as terms are needed")
    return reduce(lambda a, b: a + b, (s * F.coalesce(x, F.lit(0)) for s, x in zip(signs, xs, strict=True)))


def safe_multiply(*xs: Column) -> Column:
    """Product in which a null counts as one."""
    return reduce(lambda a, b: a * b, (F.coalesce(x, F.lit(1)) for x in xs))


def all_defined(*xs: Column) -> Column:
    return reduce(lambda a, b: a & b, (x.isNotNull() for x in xs))


def total_or_null(*xs: Column) -> Column:
    """Sum of what is there; null only if nothing is."""
    return F.when(F.coalesce(*xs).isNotNull(), safe_add(*xs))


def format_number(x: Column, places: int = 1) -> Column:
    return F.when(x.isNull(), "--").otherwise(F.format_string(f"%.{places}f", x.cast("double")))


def format_time(seconds: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    known = seconds.isNotNull() & (seconds >= 0) & (seconds <= LAST_SECOND)
    return F.when(known, F.date_format(F.timestamp_seconds(seconds), pattern)).otherwise("N/A")


#: What the bytes 128 to 159 are in windows-1252; five of them are the control characters of the same number.
WINDOWS_1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
LATIN_1 = "".join(map(chr, range(0x80, 0xA0)))


def _bytes(low: int, high: int) -> str:
    """A pattern for the characters that bytes low to high became, by windows-1252 or by latin-1."""
    odd = "".join(WINDOWS_1252[b - 0x80] for b in range(max(low, 0x80), min(high, 0x9F) + 1))
    return f"[\\x{{{low:x}}}-\\x{{{high:x}}}{odd}]"


def _mojibake() -> tuple[str, str]:
    """(sure, any): patterns of characters that are the bytes of one UTF-8 character.

    Sure ones hardly stand in a text by themselves: those of Latin-1's signs and letters, most of Latin Extended-A, of general punctuation, of
    full-width forms and of emoji. The others (é…» would be one) count only beside another.
    """
    next_ = _bytes(0x80, 0xBF)
    # Quotes, dots, dashes, blanks and signs that stand behind a capital Ä or Å of a sound text.
    sure = f"[ÂÃ]{next_}|[ÄÅ](?![‘’“”‹›«»…–—•·´°º®™‰\u00a0\u00ad]){next_}|â{_bytes(0x80, 0xAF)}{next_}|ï{_bytes(0xB8, 0xBF)}{next_}|ð{_bytes(0x9F, 0x9F)}{next_}{{2}}"
    three = f"à{_bytes(0xA0, 0xBF)}{next_}|[á-ìîï]{next_}{{2}}|í{_bytes(0x80, 0x9F)}{next_}"
    four = f"ð{_bytes(0x90, 0xBF)}{next_}{{2}}|[ñ-ó]{next_}{{3}}|ô{_bytes(0x80, 0x8F)}{next_}{{2}}"
    return sure, f"[Â-ß]{next_}|{three}|{four}"


def repair_text(t: Column, passes: int = 2) -> Column:
    """t with UTF-8 that was read as windows-1252 or latin-1 read as UTF-8 again; as often as it happened, up to `passes` times.

    Runs of such characters are decoded, whatever stands around them; a run counts if it holds a sure character or two
    characters. Null stays null; a text without such a run stays as it is. No first byte is ever a later one, so a
    run has one reading.
    """
    sure, some = _mojibake()
    pair = f"(?:{some}){{2}}"

    def once(x: Column) -> Column:
        # Possessive repeats, which no long run makes deep.
        pieces = F.regexp_extract_all(x, F.lit(f"(?s)(?:{some})++|(?:(?!{some}).)++"), F.lit(0))
        again = lambda p: F.decode(F.encode(F.translate(p, WINDOWS_1252, LATIN_1), "ISO-8859-1"), "UTF-8")
        return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(f"^(?:{some})") & (p.rlike(sure) | p.rlike(pair)), again(p)).otherwise(p)), "")

    for _ in range(passes):
        t = F.transform(F.array(t), lambda x: F.when(x.rlike(f"{sure}|{pair}"), once(x)).otherwise(x))[0]
    return t


def clean_text(t: Column) -> Column:
    """t repaired, each run of white space a blank, none at either end; Unicode's white space counts, the separators 28 to 31 too."""
    return F.trim(F.regexp_replace(repair_text(t), r"(?U)[\s\x1c-\x1f]+", " "))


def words(t: Column) -> Column:
    """The white-space separated words; none for a blank or null text."""
    return F.filter(F.split(F.coalesce(t, F.lit("")), r"\s+"), lambda w: w != "")


def split_text(t: Column, punctuation: bool = False) -> Column:
    return F.regexp_extract_all(t, F.lit(r"[\w]+|[.,!?;]"), F.lit(0)) if punctuation else words(t)


def endless(vocabulary: Column, n: Column, start: int = 0) -> Column:
    """n words, going round the vocabulary; none from an empty one."""
    at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: vocabulary[((i + start) % F.size(vocabulary)).cast("int")])
    return F.array_join(F.when((n > 0) & (F.size(vocabulary) > 0), at).otherwise(F.array().cast("array<string>")), " ")


def fit(width: Column, height: Column, most_width: int, most_height: int) -> tuple[Column, Column]:
    """Size within a box at the same aspect ratio, never enlarged."""
    k = F.least(F.lit(1.0), most_width / width, most_height / height)
    return tuple(F.greatest(F.lit(1), F.bround(x * k).cast("int")) for x in (width, height))


def float_around(mean: float, u: Column, z: Column, spread: float | None = None, least: float | None = None, most: float | None = None) -> Column:
    """A number around mean: constant, even between bounds by u in (0, 1), or normal between bounds by z; never below zero."""
    if spread is None and least is None and most is None or least is not None and least == most:
        return F.lit(float(mean if least is None else least))
    lo = max(0.0, mean - 5 * (spread or 0) if least is None else least)
    hi = mean + 5 * (spread or 0) if most is None else most
    return lo + u * (hi - lo) if spread is None else F.greatest(F.lit(lo), F.least(F.lit(float(hi)), mean + spread * z))


def filter_text(t: Column, start: str | int | None = None, end: str | int | None = None) -> Column:
    """The text from a marker or place on, and of the text before a marker or up to a place; both are looked for in the whole text.

    The end counts from where the text then begins. A marker that isn't there is an error.
    """

    def place(mark: str | int | None) -> Column | None:
        if not mark:
            return None
        if isinstance(mark, int):
            return F.lit(mark)
        at = F.instr(t, mark) - 1
        return F.when(at < 0, F.raise_error(F.lit(f"no {mark!r} in the text")).cast("int")).otherwise(at)

    a, z = place(start), place(end)
    out = t if a is None else F.substring(t, a + 1, F.length(t))
    return out if z is None else F.substring(out, F.lit(1), z)


def is_punctuation(t: Column) -> Column:
    """Whether t is one character that is no letter, digit or white space."""
    return (F.length(t) == 1) & ~F.regexp_like(t, F.lit(r"^[\p{L}\p{N}\s]$"))


def camelize(t: Column) -> Column:
    """snake_case as camelCase."""
    parts = F.split(t, "_")
    return F.concat(F.lower(parts[0]), F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 1)), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), ""))


def wrap(t: Column, width: int) -> Column:
    """Lines of at most `width` characters, broken between words, as an array; a longer word has a line of its own."""
    last = lambda a: F.element_at(a, -1)

    def step(lines: Column, w: Column) -> Column:
        joined = F.concat(last(lines), F.lit(" "), w)
        fits = (F.size(lines) > 0) & (F.length(last(lines)) + 1 + F.length(w) <= width)
        return F.when(fits, F.concat(F.slice(lines, F.lit(1), F.size(lines) - 1), F.array(joined))).otherwise(F.concat(lines, F.array(w)))

    return F.aggregate(words(t), F.array().cast("array<string>"), step)


def value_display(x: Column, label: str, units: str = "", places: int = 0, width: int = 0) -> Column:
    """A number with its unit and label, right-aligned."""
    shown = F.concat(F.format_string(f"%.{places}f", x.cast("double")), F.lit(f"{units} [{label}]"))
    return F.when(F.length(shown) < width, F.lpad(shown, width, " ")).otherwise(shown) if width else shown


def merged_map(base: Column, more: Column) -> Column:
    """A map with the entries of another, which win."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(more, k)), more)


def renamed_keys(m: Column, names: dict[str, str]) -> Column:
    return F.transform_keys(m, lambda k, v: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), k), k))


def without_keys(m: Column, *keys: str) -> Column:
    return F.map_filter(m, lambda k, v: ~k.isin(*keys))


def as_json(t: Column) -> Column:
    """The text if it is a JSON object or array, else null."""
    return F.when(F.regexp_like(t, F.lit(r"^\s*[\[{]")) & F.try_parse_json(t).isNotNull(), t)


#: Named resolutions.
RESOLUTIONS = {"240p": (426, 240), "360p": (640, 360), "480p": (854, 480), "540p": (960, 540), "720p": (1280, 720), "1080p": (1920, 1080), "1440p": (2560, 1440), "2160p": (3840, 2160), "4k": (3840, 2160)}


def resolution(name: Column) -> Column:
    """(width, height) of a named resolution; null for others."""
    size = F.create_map(*(x for n, (w, h) in RESOLUTIONS.items() for x in (F.lit(n), F.struct(F.lit(w).alias("width"), F.lit(h).alias("height")))))
    return F.try_element_at(size, F.lower(name))


def aspect_ratio(t: Column) -> Column:
    """W:H or W/H as a number; anything else is an error."""
    parts = F.split(t, "[:/]")
    ratio = F.try_divide(F.expr("1.0D") * F.try_element_at(parts, F.lit(1)).try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double"))
    return F.when((F.size(parts) == 2) & ratio.isNotNull(), ratio).otherwise(F.raise_error(F.lit("W:H or W/H is needed")).cast("double"))


def reasoning(t: Column, mode: bool | str = True) -> Column:
    """Reasoning in <think> tags or in a template with {reasoning}; null where there is none, or if mode is false."""
    if not mode:
        return F.lit(None).cast("string")
    before, _, after = ("<think>{reasoning}</think>" if mode is True else mode).partition("{reasoning}")
    return F.when(F.length(t) > 0, F.concat(F.lit(before), t, F.lit(after)))
