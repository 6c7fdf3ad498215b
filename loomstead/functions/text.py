"""Text expressions, all JVM-side. Null in, null out unless said otherwise; a failed extraction is null, not empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Precomposed Latin letters and their bases, for a `normalize` that Spark lacks.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēęěğģīįķļńņňōőŕřśşšţťūůűųźżž"
BASES = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeeggiiklnnnoorrsssttuuuuzzz"
QUOTES = "[׳״\"']"


def null_if_blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def normalize_name(c: Column) -> Column:
    """Lower case without combining marks and accents, blanks single."""
    return F.translate(F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, r"\p{Mn}", ""), r"\s+", " "))), ACCENTED, BASES)


def trigrams(c: Column) -> Column:
    """Distinct character trigrams; none below three characters (`sequence` would count down)."""
    return F.when(F.length(c) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def name_similarity(a: Column, b: Column) -> Column:
    """0 for an empty side, 1 for equal names, else trigram Jaccard; token Jaccard where a side has no trigram."""
    return normalized_similarity(normalize_name(a), normalize_name(b))


def normalized_similarity(na: Column, nb: Column) -> Column:
    """``name_similarity`` of names that are normalized already."""
    ta, tb = trigrams(na), trigrams(nb)
    words = jaccard(F.array_distinct(F.split(na, " ")), F.array_distinct(F.split(nb, " ")))
    blank = F.coalesce(F.length(na), F.lit(0)) * F.coalesce(F.length(nb), F.lit(0)) == 0
    return F.when(blank, F.lit(0.0)).when(na == nb, F.lit(1.0)).when((F.size(ta) == 0) | (F.size(tb) == 0), words).otherwise(jaccard(ta, tb))


def place_key(c: Column) -> Column:
    """Blanks single, quotes and points stripped from the ends."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), r"^[׳״\"'., ]+", ""), r"[׳״\"'., ]+$", "")


def group_key(c: Column) -> Column:
    """Quotes removed anywhere."""
    return F.trim(F.regexp_replace(c, QUOTES, ""))


def alnum_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def split_list(c: Column, sep: str = ";") -> Column:
    """Trimmed, non-blank parts in order."""
    return F.filter(F.transform(F.split(c, sep), lambda x: F.trim(x)), lambda x: x != "")


def classify_tag(c: Column) -> Column:
    """First that holds: to be done, Hebrew letters, a wrong separator, no colon; else ok."""
    return F.when(F.lower(c).startswith("tbd"), "tbd").when(c.rlike("[א-ת]"), "hebrew").when(c.rlike("[,/|]"), "bad-sep").when(~c.contains(":"), "no-colon").otherwise("ok")


def has_hebrew(c: Column) -> Column:
    return c.rlike(r"[֐-׿]")


def hebrew_length(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^א-ת]", ""))


def is_acronym(c: Column) -> Column:
    """A letter, gershayim or a quote, a letter."""
    return c.rlike("[א-ת][״\"][א-ת]")


def hebrew_prefix(c: Column, letters: str = "בלמהוכש") -> Column:
    """struct(prefix, bare): an attached letter parted from a Hebrew word of three letters or more."""
    cut = F.substring(c, 1, 1).isin(*letters) & F.substring(c, 2, 1).rlike("[א-ת]") & (F.length(c) > 2)
    return F.struct(F.when(cut, F.substring(c, 1, 1)).otherwise("").alias("prefix"), F.when(cut, F.substring(c, F.lit(2), F.length(c))).otherwise(c).alias("bare"))


def gazetteer_number(c: Column) -> Column:
    """The integer of either URL form, of a prefixed id or of a bare number."""
    got = F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in (r"[?&]id=(\d+)", r"/Details/(\d+)", r"^kima:(\d+)$", r"^\s*(\d+)(?:\.0*)?\s*$")])
    return got.cast("bigint")


def item_number(c: Column) -> Column:
    """The Q number at the end of a URL or standing alone."""
    return F.nullif(F.regexp_extract(c, r"(Q\d+)\s*/?$", 1), F.lit(""))


def id_suffix_number(c: Column, missing: int = 999999) -> Column:
    """The number an id ends in, for natural order."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"(\d+)$", 1), F.lit("")).cast("int"), F.lit(missing))


def story_page(c: Column) -> Column:
    return F.regexp_replace(c, r"_\d+[A-Za-z]?$", "")


def chunks(c: Column, size: int = 1000, overlap: int = 200) -> Column:
    """array(struct(offset, chunk)): windows that overlap; one for a text that fits. A tail may lie within the last overlap."""
    starts = F.when(F.length(c) <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.length(c) - 1, F.lit(size - overlap)))
    return F.transform(starts, lambda i: F.struct(i.alias("offset"), F.substring(c, i + 1, F.lit(size)).alias("chunk")))


def hebrew_words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("[\\u0590-\\u05FF]+"), F.lit(0))


def latin_words(c: Column, least: int = 2) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z]+", " "), " "), lambda w: F.length(w) >= least)


#: Letters that may be attached before and after a Hebrew word.
PREFIX_LETTERS, SUFFIX_LETTERS = "והבלמכשדיתנא", "יהםותןךנ"


def term_in_text(text: Column, term: Column) -> Column:
    """A Hebrew word as a whole token with up to three prefix and three suffix letters; other terms as substrings."""
    word = F.concat(F.lit(rf"(?:^|[^֐-׿])[{PREFIX_LETTERS}]{{0,3}}\Q"), term, F.lit(rf"\E[{SUFFIX_LETTERS}]{{0,3}}(?:$|[^֐-׿])"))
    return F.when(term.rlike("^[֐-׿]+$"), F.rlike(text, word)).otherwise(text.contains(term))


def tri_state(c: Column) -> Column:
    """True, false or null for an answer."""
    v = F.lower(F.trim(c))
    return F.when(v.isin("true", "yes", "y", "1", "applies"), True).when(v.isin("false", "no", "n", "0", "does not apply"), False)


def excerpt(text: Column, term: Column, before: int = 80, width: int = 200) -> Column:
    """The window around a term's first place, or the opening."""
    at = F.instr(text, term)
    return F.substring(text, F.greatest(at - before, F.lit(1)), F.lit(width))


def short_hash(c: Column) -> Column:
    return F.substring(F.md5(c), 1, 8)


def verdict_json(c: Column) -> Column:
    """struct(applies, confidence, reasoning) of a model's reply, fences and talk around the object ignored; nulls where it is malformed."""
    body = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.from_json(body, "applies boolean, confidence string, reasoning string")


def distance_label(km: Column) -> Column:
    return F.when(km.isNull(), "no distance").when(km < 1, F.concat(F.format_number(km * 1000, 0), F.lit(" m"))).otherwise(F.concat(F.format_number(km, 1), F.lit(" km")))


def sentences(c: Column, least: int = 12) -> Column:
    """Sentences of more than ``least`` characters with a Hebrew letter, the story's id and tag mark before them dropped."""
    body = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\S+\s+תיוגים\*?\s*", "")
    return F.filter(F.transform(F.split(body, r"(?<=[.!?׃:])\s+|\n+"), lambda s: F.trim(s)), lambda s: (F.length(s) > least) & s.rlike("[א-ת]"))


def clip(c: Column, most: int = 130) -> Column:
    """At most so many characters, cut before a word, with an ellipsis."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, most), r" [^ ]*$", ""), F.lit("…")))


def context_window(text: Column, start: Column, end: Column, width: int) -> Column:
    """So many characters on either side of a span, with ellipses where more follows."""
    a, b = F.greatest(start - width, F.lit(0)), F.least(end + width, F.length(text))
    return F.concat(F.when(a > 0, "…").otherwise(""), F.substring(text, a + 1, b - a), F.when(b < F.length(text), "…").otherwise(""))


def containing_word(text: Column, start: Column, end: Column) -> Column:
    """The word around a span up to the next blanks; empty where the span is that word."""
    left, right = F.regexp_extract(F.substring(text, F.lit(1), start), r"(\S*)$", 1), F.regexp_extract(F.substring(text, end + 1, F.length(text)), r"^(\S*)", 1)
    return F.when((left == "") & (right == ""), "").otherwise(F.concat(left, F.substring(text, start + 1, end - start), right))


def script(c: Column) -> Column:
    """``he`` where a Hebrew letter stands in a name, else ``en``."""
    return F.when(has_hebrew(c), "he").otherwise("en")


def near_equal(a: Column, b: Column, compound: str = "major+minor", parts: tuple[str, str] = ("major", "minor")) -> Column:
    """Equal, or a compound against one of its parts."""
    return (a == b) | ((a == compound) & b.isin(*parts)) | ((b == compound) & a.isin(*parts))


def highest(tokens: Column, ranks: list[str], default: str) -> Column:
    """The last of ``ranks`` among an array of tokens, else the default."""
    rank = F.array_max(F.transform(tokens, lambda t: F.array_position(F.array(*[F.lit(r) for r in ranks]), t)))
    return F.when(rank > 0, F.element_at(F.array(*[F.lit(r) for r in ranks]), rank.cast("int"))).otherwise(F.lit(default))


def topics(tokens: Column, skip: str | None = None) -> Column:
    """Tokens with a colon that are not to be done, without those of one prefix."""
    ok = lambda t: t.contains(":") & ~F.upper(t).startswith("TBD") & (~t.startswith(f"{skip}:") if skip else F.lit(True))
    return F.filter(tokens, ok)


def duration(seconds: Column) -> Column:
    """``1h02m``, ``3m05s`` or ``7s``."""
    s = seconds.cast("bigint")
    return F.when(s >= 3600, F.format_string("%dh%02dm", F.expr("1") * F.floor(s / 3600), F.floor(s % 3600 / 60))).when(s >= 60, F.format_string("%dm%02ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%ds", s))


def humanized(tag: Column) -> Column:
    """The part after the first colon, underscores as blanks."""
    return F.replace(F.when(tag.contains(":"), F.substring_index(tag, ":", -1)).otherwise(tag), F.lit("_"), F.lit(" "))


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


#: What stands before a name inside of it where two were run together; marks that alone make no name.
HONORIFICS, ONLY_MARKS = 'ר׳|הרב|רבי|מהר|מורנו|ה״ה|כ״ק|ר"', "^[\\s׳״\"'.,:;!?()–—\\-/\\\\|]+$"


def entity_flags(text: Column, kind: Column) -> Column:
    """Array of what is suspicious about a marked name: ``short_fragment``, ``punct_only``, ``xmlid_leak``, ``fused_entity``."""
    t = F.trim(text)
    fused = kind.isin("persName", "placeName") & ~t.rlike(r"\s") & (hebrew_length(t) > 6) & t.rlike(f"^(?!{HONORIFICS}).+?(?:{HONORIFICS}).*[א-ת]")
    flags = [F.when(kind.isin("persName", "placeName", "orgName") & (F.length(t) <= 2), "short_fragment"), F.when(t.rlike(ONLY_MARKS), "punct_only"), F.when(t.rlike("_0[0-9]"), "xmlid_leak"), F.when(fused, "fused_entity")]
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*flags)))


def needs_context(status: Column, flags: Column, candidates: Column) -> Column:
    """Whether a match must be looked at in its text: ambiguous, of another sound, or fuzzy with several candidates."""
    return F.coalesce(status == "name_ambiguous", F.lit(False)) | F.coalesce(flags.contains("phonetic_mismatch"), F.lit(False)) | F.coalesce((status == "fuzzy") & (F.size(candidates) > 1), F.lit(False))


def risk(name: Column, method: Column, region: Column, implausible: list[str], homographs: list[str]) -> Column:
    """struct(risk, reason) of a link, the first rule that holds."""
    h, m = F.trim(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(method, F.lit("")))
    bad = F.regexp_extract(F.coalesce(region, F.lit("")), "(" + "|".join(implausible) + ")", 1)
    say = lambda r, why: F.struct(F.lit(r).alias("risk"), F.lit(why).alias("reason"))
    return F.when(bad != "", say("HIGH", "region")).when(h.isin(*homographs), say("HIGH", "homograph")).when(m.contains("wikidata"), say("LOW", "identity")).when((h != "") & (hebrew_length(h) <= 4), say("HIGH", "short")).when((h == "") & m.contains("name_exact"), say("LOW", "romanized")).when(m.contains("name_exact"), say("MED", "exact name")).otherwise(say("MED", "review"))


def mapped(c: Column, names: dict[str, str]) -> Column:
    """A code's name, or the code itself."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in sorted(names.items()) for x in kv]), c), c)


def highlighted(text: Column, words: list[str]) -> Column:
    """Each word between double asterisks."""
    for w in words:
        text = F.replace(text, F.lit(w), F.lit(f"**{w}**"))
    return text
