"""Cue clean-up, tokenising and word comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything Unicode counts as white space, plus the four ASCII separators.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# What collapsing changes: a run of white space that is more than one plain space.
_RUN = " " + SPACE + "+|" + SPACE.replace(r"[\s", r"[\t\n\f\r", 1) + SPACE + "*"

# Markup, and sound cues or a leading speaker label.
TAG = r"<[^>]+>|\{[^}]*\}"
SOUND_CUE = r"\([^)]*\)|\[[^\]]*\]|^[A-Z][A-Z '\.]{1,20}:"

# The characters of SPACE but for the plain space: one byte each, and the others.
_ODD_ASCII = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
_ODD_WIDE = "\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"


def _holds_any(text: Column, pieces) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in pieces])


def collapse_space(text: Column) -> Column:
    """Single-spaced text. Byte searches tell which texts need a pass of the pattern at all."""
    wide = (F.octet_length(text) != F.length(text)) & _holds_any(text, _ODD_WIDE)
    return F.trim(F.when(_holds_any(text, ("  ", *_ODD_ASCII)) | wide, F.regexp_replace(text, _RUN, " ")).otherwise(text))


def not_blank(text: Column) -> Column:
    """Whether ``collapse_space`` leaves anything, without a pass over the text."""
    return text.rlike("[^" + SPACE[1:])


def clean_cue_text(text: Column, strip_sound_cues: bool = True) -> Column:
    """Drop markup, blank out sound cues and a leading label, single-space the rest."""
    bare = F.regexp_replace(text, TAG, "")
    if strip_sound_cues:
        bare = F.regexp_replace(bare, SOUND_CUE, " ")
    return collapse_space(bare)


def normalize_word(word: Column) -> Column:
    """Lower-case, keep only a-z and apostrophes, then strip outer apostrophes."""
    return F.btrim(F.regexp_replace(F.lower(word), r"[^a-z']+", ""), F.lit("'"))


def normalize_words(text: Column) -> Column:
    """``normalize_word`` of each word of a single-spaced line, by passes over the line instead of over each word."""
    def stripped(bare: Column) -> Column:
        # An outer run is looked at once, at its first apostrophe.
        outer = F.regexp_replace(bare, r"(?<![^ ])'++|(?<!')'++(?= |\z)", "")
        return F.split(F.when(F.contains(bare, F.lit("'")), outer).otherwise(bare), " ")

    return let(F.regexp_replace(F.lower(text), r"[^a-z' ]+", ""), stripped)


# The characters Windows code page 1252 places at bytes 0x80-0x9f, and those bytes as
# ISO 8859-1 controls. Five of the bytes have no character.
_CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
_CONTROLS = "".join(map(chr, (
    0x80, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8a, 0x8b, 0x8c, 0x8e, 0x91, 0x92, 0x93,
    0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9a, 0x9b, 0x9c, 0x9e, 0x9f)))


def mojibake(text: Column) -> tuple[Column, Column, Column]:
    """Whether a text looks like UTF-8 read as code page 1252, whether it can be encoded in that, and if so what its bytes read as
    (which may not be valid UTF-8)."""
    suspect = text.contains("â€") | text.contains("Ã")
    # A C1 control in the input is not a 1252 character, so the round trip must leave such text alone.
    encodable = ~text.rlike(rf"[^\x{{00}}-\x{{7f}}\x{{a0}}-\x{{ff}}{_CP1252}]")
    raw = F.encode(F.translate(F.when(encodable, text), _CP1252, _CONTROLS), "iso-8859-1")
    return suspect, encodable, raw.cast("string")


def repair_mojibake(text: Column) -> Column:
    """Undo UTF-8 that was read as code page 1252; text that does not decode stays as it is."""
    suspect = mojibake(text)[0]
    _, encodable, decoded = mojibake(F.when(suspect, text))
    return F.when(suspect & encodable & F.is_valid_utf8(decoded), decoded).otherwise(text)


# The OCR corrections, in order.
_OCR_STEPS = (
    (r"[|l](?<![A-Za-z0-9][|l])(?=['’]|" + SPACE + ")", "I"),
    (r"0(?<=[a-z]0)(?=[a-z])", "o"),
    ("[“”]", '"'),
    ("[‘’]", "'"),
    (_RUN, " "),
)


def ocr_cleanup(text: Column) -> Column:
    """Repair the usual misreadings of recognised subtitle text."""
    out = F.btrim(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit(" " + _ODD_ASCII + _ODD_WIDE))
    for pattern, replacement in _OCR_STEPS:
        out = F.regexp_replace(out, pattern, replacement)
    return F.btrim(out, F.lit(" -—"))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; inside a lambda a plain expression runs per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_CHUNK = 32


def offsets_of(tokens: Column) -> Column:
    """The offset of each token in the single-spaced line.

    A prefix sum per token, or one list grown over all, would be quadratic in the length of a line. Chunks of 32 tokens are
    summed once, and each grows its own short list from there, inside the row and without a shuffle.
    """
    zero = F.lit(0).cast("bigint")

    def grown(start: Column, steps: Column) -> Column:
        return F.aggregate(steps, F.array(start), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))

    def bound(widths: Column) -> Column:
        last = F.call_function("div", F.greatest(F.size(widths) - 1, F.lit(0)), F.lit(_CHUNK)).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(widths, c * _CHUNK + 1, F.lit(_CHUNK)))

        def placed(chunks: Column) -> Column:
            sums = F.transform(chunks, lambda c: F.aggregate(c, zero, lambda a, x: a + x))
            # The last sum of a chunk belongs to the next one.
            return let(grown(zero, sums), lambda before: F.flatten(F.transform(chunks, lambda c, i: F.slice(
                grown(F.get(before, i), c), F.lit(1), F.size(c)))))

        return let(chunks, placed)

    return let(F.transform(tokens, lambda t: (F.length(t) + 1).cast("bigint")), bound)


def with_offsets(tokens: Column, body) -> Column:
    """Give ``body`` the tokens and a function from a token's index to its offset in the single-spaced line."""
    return let(tokens, lambda ts: let(offsets_of(ts), lambda offsets: body(ts, lambda i: F.get(offsets, i.cast("int")))))


def token_offsets(tokens: Column) -> Column:
    """(token, offset) pairs of a single-spaced line."""
    return let(tokens, lambda ts: F.arrays_zip(ts.alias("token"), offsets_of(ts).alias("offset")))


def strip_possessive(word: Column) -> Column:
    return F.when(F.endswith(word, F.lit("'s")), F.left(word, F.length(word) - 2)).otherwise(word)


def word_matches(heard: Column, target: Column) -> Column:
    """Same word, same but for a trailing ``'s``, or one begins with the other (3 letters or more)."""
    h, t = strip_possessive(heard), strip_possessive(target)
    shorter = F.when(F.length(t) < F.length(h), t).otherwise(h)
    longer = F.when(F.length(t) < F.length(h), h).otherwise(t)
    return (heard == target) | (h == t) | ((F.length(shorter) >= 3) & longer.startswith(shorter))


def match_key(word: Column) -> Column:
    """Two words that match always share this key, so the match runs as an equi-join."""
    return F.substring(strip_possessive(word), 1, 3)


def bracket_word(reasoning: Column) -> Column:
    """The text inside a leading ``[...]``, else null."""
    found = F.regexp_extract(F.coalesce(reasoning, F.lit("")), r"^\[([^\]]+)\]", 1)
    return F.when(found != "", found)


def finding_type(reasoning: Column, category: Column) -> Column:
    """What a reviewer groups by: the spoken word, else the category."""
    return F.coalesce(bracket_word(reasoning), category)


def strip_policy_note(reasoning: Column) -> Column:
    """The description without its trailing ``; policy: ...`` note."""
    return F.trim(F.regexp_replace(F.coalesce(reasoning, F.lit("")), r";?\s*policy:.*$", ""))


def base_name_key(path: Column) -> Column:
    """Lower-cased last part of a path, with either kind of slash."""
    return F.lower(F.element_at(F.split(F.rtrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/")), "/"), -1))


def file_stem(name: Column) -> Column:
    """File name without its last suffix; a leading dot does not start a suffix."""
    return F.regexp_replace(name, r"(?s)(?<=.)\.[^.]+\z", "")


def file_suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(?s).(\.[^.]+)\z", 1))


def _quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c.isascii() and not c.isspace() else c for c in text)


def fuzzy_match(query: str, name: Column) -> Column:
    """The query occurs in the name, or its characters do in order. Both already lower-cased."""
    # Each character's first place after the one before; nothing is tried twice, so a miss costs one pass.
    loose = "^" + "".join(f"[^{_quoted(c)}]*+{_quoted(c)}" for c in query)
    return name.contains(query) | name.rlike(loose)


def match_rank(query: str, name: Column) -> Column:
    """0 prefix, 1 substring, 2 in-order characters."""
    return F.when(name.startswith(query), 0).when(name.contains(query), 1).otherwise(2)


def prompt_digest(prompt: Column) -> Column:
    return F.substring(F.sha2(prompt, 256), 1, 16)


def quick_fingerprint(content: Column, chunk: int = 8 * 1024 * 1024) -> Column:
    """Size plus head, middle and tail chunks of a binary column, hashed."""
    size = F.octet_length(content).cast("bigint")
    half = F.call_function("div", size, F.lit(2)) - chunk // 2
    middle, tail = F.greatest(half, F.lit(0)), F.greatest(size - chunk, F.lit(0))

    def piece(offset: Column) -> Column:
        return F.substring(content, (offset + 1).cast("int"), F.lit(chunk))

    seen = F.concat(F.encode(size.cast("string"), "utf-8"), piece(F.lit(0)), piece(middle), piece(tail))
    return F.concat(F.lit("quickhash:"), F.sha2(seen, 256))
