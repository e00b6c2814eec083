"""Problem 9: one consistent form for texts that look the same.

The comparison form is compatibility normalisation (composed), full case folding, blanks mapped to one kind and removal of
default-ignorable characters, with letters of other scripts that are drawn like Latin ones mapped to those; it decides which
texts may look the same. It is worked out for whole batches of distinct texts at a time. Only texts that share it with a
different text are looked at again: the visual form keeps apart what the eye can tell apart (case, accents, raised signs).
"""

from __future__ import annotations

import re
import unicodedata as U

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.plans.cut import cut

# --- fixed values ------------------------------------------------------------------------------------------------
#: Hyphens drawn like the ASCII one.
HYPHENS = "\u2010\u2011"
#: Line ends other than the line feed.
LINE_ENDS = "\x85\u2028\u2029"
#: Default-ignorable code points of the Unicode character database, as ranges.
IGNORABLE = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF))
#: Compatibility characters (tag <compat>) whose parts look like the whole: micro sign, digraphs, dot leaders, Roman numerals, Latin ligatures.
LOOKS_LIKE_PARTS = ((0xB5, 0xB5), (0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0x2024, 0x2026), (0x2160, 0x217F), (0xFB00, 0xFB06))
#: Blanks of category Zs end at the ideographic space (0x3000).
LAST_BLANK = 0x3000
#: Compatibility tags that only tell of width or line breaking.
SAME_SHAPE = ("<wide>", "<narrow>", "<noBreak>", "<small>")
#: Letters composed with a mark lie below this code point.
LAST_MARKED = 0x2000
#: Cased letters lie below this code point.
LAST_CASED = 0x20000
# ----------------------------------------------------------------------------------------------------------------

#: A zero-width joiner between two pictographs is seen (it makes one picture of them).
_PICTURE = "[\u2190-\u2bff\U0001f000-\U0001faff]"
JOINED = re.compile(f"({_PICTURE}[\ufe0f\U0001f3fb-\U0001f3ff]*)\u200d(?={_PICTURE})")
KEPT_JOINER = "\x01"
#: The basic plane's last character.
LAST_NEAR = "\uffff"
FAR = re.compile("[\U00010000-\U0010ffff]")
PLAIN = re.compile(r"[\n\x20-\x7e]*\Z")


def _within(cp: int, ranges) -> bool:
    return any(a <= cp <= b for a, b in ranges)


def look_alike_letters(spark: SparkSession) -> dict[int, str]:
    """Letters of other scripts (code points) -> the ASCII letter of the same case that they are drawn like.

    Which are drawn alike is the published Unicode confusables data, as the library that comes with Spark has it: letters of
    one prototype. Caseless scripts, other Latin letters and compatibility characters (styled letters) stay themselves.
    """
    other = [c for c in map(chr, range(0x80, LAST_CASED)) if U.category(c) in ("Lu", "Ll") and not U.decomposition(c) and not U.name(c, "LATIN").startswith("LATIN")]
    ascii_letters = [c for c in map(chr, range(0x41, 0x7B)) if c.isalpha()]
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    prototypes = checker.getSkeleton(0, "\n".join(ascii_letters + other)).split("\n")
    latin = {(p, U.category(a)): a for a, p in zip(ascii_letters, prototypes, strict=False)}
    found = zip(other, prototypes[len(ascii_letters) :], strict=True)
    return {ord(c): latin[p, U.category(c)] for c, p in found if (p, U.category(c)) in latin}


class Shapes(dict):
    """Translation of single characters to what they look like, worked out when a character is first met."""

    def __init__(self, letters: dict[int, str]):
        super().__init__()
        self.letters = letters

    def __reduce__(self):
        return Shapes, (self.letters,)

    def __missing__(self, cp: int):
        self[cp] = out = self.shape(cp)
        return out

    def shape(self, cp: int) -> str | None:
        c = chr(cp)
        if c == KEPT_JOINER or c == "\n":
            return c
        if c in LINE_ENDS:
            return "\n"
        if c == "\t" or U.category(c) == "Zs":
            return " "
        if _within(cp, IGNORABLE) or U.category(c) == "Cc":
            return None
        if c in HYPHENS:
            return "-"
        tag = U.decomposition(c).split(" ")
        if tag[0] in SAME_SHAPE or (tag[0] == "<compat>" and _within(cp, LOOKS_LIKE_PARTS)):
            parts = U.normalize("NFD", "".join(chr(int(x, 16)) for x in tag[1:]))
            return parts.translate(self)
        return self.letters.get(cp) or c


class Forms:
    """The two forms of a text. ``letters``: see :func:`look_alike_letters`."""

    def __init__(self, letters: dict[int, str]):
        self.letters, self.shapes = letters, Shapes(letters)
        blank = {c for c in map(chr, range(LAST_BLANK + 1)) if U.category(c) == "Zs"} | {"\t", "\n", "\r", *LINE_ENDS}
        # control characters and the kept joiner go; the separator stays
        gone = {chr(c) for a, b in IGNORABLE for c in range(a, b + 1)} | {chr(c) for c in (*range(0x20), *range(0x7F, 0xA0))} - blank
        alike = {chr(c): a for c, a in letters.items()}
        # a letter with a mark is drawn like the Latin letter with that mark
        marked = {c: d.translate(letters) for c in map(chr, range(0xC0, LAST_MARKED)) if len(d := U.normalize("NFD", c)) > 1 and d[0] in alike}
        self.table = dict.fromkeys(gone, "") | dict.fromkeys(blank, " ") | dict.fromkeys(HYPHENS, "-") | alike | marked
        self.table.pop(" ")
        # beyond the basic plane a character class is looked through one by one, so those have their own
        self.mapped = [re.compile("[" + "".join(re.escape(c) for c in sorted(self.table) if (c > LAST_NEAR) == far) + "]") for far in (False, True)]

    def __reduce__(self):
        return Forms, (self.letters,)

    def visual(self, text: str) -> str:
        """What the eye gets: the same for two texts of the same letters, marks, digits, signs and gaps.

        Widths, invisible characters, kinds of blank and the script of look-alike letters are evened out; letter case,
        accents, raised, circled or styled forms and other signs stay apart.
        """
        if PLAIN.match(text):
            return text
        text = JOINED.sub(r"\1" + KEPT_JOINER, text.replace(KEPT_JOINER, "").replace("\r\n", "\n").replace("\r", "\n"))
        return U.normalize("NFC", U.normalize("NFD", text).translate(self.shapes))

    def folded(self, text: str) -> str:
        """The comparison form. Texts of one visual form have one comparison form."""
        text = U.normalize("NFKC", text.replace("\r\n", "\n"))
        text = self.mapped[0].sub(lambda m: self.table[m[0]], text)
        if FAR.search(text):
            text = FAR.sub(lambda m: self.mapped[1].sub(lambda c: self.table[c[0]], m[0]), text)
        return U.normalize("NFKC", U.normalize("NFKC", text).casefold())

    def folded_all(self, texts: list[str]) -> list[str]:
        """:meth:`folded` of each text."""
        return [t.lower().replace("\n", " ") if PLAIN.match(t) else self.folded(t) for t in texts]


def _digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode())


def _blank(folded: str) -> bool:
    return not folded.strip(" ")


def _keys(letters: dict[int, str]):
    """doc_id, and 128-bit hashes of the comparison form and of the text; null hashes for a blank text."""

    def run(batches):
        forms = Forms(letters)
        for batch in batches:
            distinct = batch["text"].dictionary_encode()
            folded = forms.folded_all(texts := distinct.dictionary.to_pylist())
            keys = [(None, None) if _blank(f) else (_digest(f), _digest(t)) for f, t in zip(folded, texts, strict=True)]
            cols = [pa.array([k[i] for k in keys], pa.binary()).take(distinct.indices) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *cols], ["doc_id", "folded", "exact"])

    return run


def _looks(letters: dict[int, str]):
    """128-bit hashes of the text and of its visual form."""

    def run(batches):
        forms = Forms(letters)
        for batch in batches:
            texts = batch["text"].unique().to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([_digest(t) for t in texts], pa.binary()), pa.array([_digest(forms.visual(t)) for t in texts], pa.binary())], ["exact", "visual"])

    return run


def _texts(letters: dict[int, str]):
    def run(batches):
        forms = Forms(letters)
        for batch in batches:
            distinct = batch["text"].dictionary_encode()
            folded = forms.folded_all(texts := distinct.dictionary.to_pylist())
            pairs = [(None, None) if _blank(f) else (f, forms.visual(t).replace(KEPT_JOINER, "\u200d")) for f, t in zip(folded, texts, strict=True)]
            cols = [pa.array([p[i] for p in pairs], pa.string()).take(distinct.indices) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *cols], ["doc_id", "folded", "visual"])

    return run


def consistent_texts(documents: DataFrame) -> DataFrame:
    """doc_id, folded, visual: every row's text in the comparison form and in the form the eye gets.

    Null, empty and blank texts (nothing but blanks and invisible characters) have null forms. Repeated rows stay
    repeated, other columns are ignored, whole texts are worked on however long, each distinct text of a batch once.
    """
    letters = look_alike_letters(documents.sparkSession)
    return documents.select("doc_id", "text").mapInArrow(_texts(letters), "doc_id bigint, folded string, visual string")


def look_classes(documents: DataFrame) -> DataFrame:
    """doc_id, class_id, spelling_id: the documents whose text looks the same as a different text.

    class_id is the smallest doc_id of those that look the same, spelling_id the smallest of those of the same text; one row
    per document, however many copies a text has. Null, empty and blank texts are in no class; rows without doc_id are left
    out; a repeated row counts once.

    Texts that share the 128-bit hash of their comparison form with a different text are candidates; one document of each is
    read again and their visual forms are compared (by 128-bit hash). Other texts are read once and never shuffled.
    """
    letters = look_alike_letters(documents.sparkSession)
    read = documents.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    keys = cut(read.mapInArrow(_keys(letters), "doc_id bigint, folded binary, exact binary").where("folded IS NOT NULL"), "looks")
    mixed = keys.groupBy("folded").agg(F.min("exact").alias("_a"), F.max("exact").alias("_b")).where("_a <> _b").select("folded")
    some = cut(keys.join(mixed, "folded", "left_semi").select("doc_id", "exact"), "looks")
    # one document stands for all of a text
    spellings = cut(some.groupBy("exact").agg(F.min("doc_id").alias("spelling_id")), "spellings")
    again = read.join(spellings.select(F.col("spelling_id").alias("doc_id")), "doc_id", "left_semi").select("text")
    looks = again.mapInArrow(_looks(letters), "exact binary, visual binary").distinct()
    looks = spellings.join(looks, "exact")
    classes = looks.groupBy("visual").agg(F.min("spelling_id").alias("class_id"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    placed = cut(looks.join(classes, "visual").select("exact", "class_id", "spelling_id"), "look-classes")
    return some.join(placed, "exact").select("doc_id", "class_id", "spelling_id").distinct()


def look_alikes(documents: DataFrame) -> DataFrame:
    """doc_a < doc_b: all pairs of documents of :func:`look_classes` whose texts look the same and differ.

    The number of pairs is that of the true cases; where texts have many copies, the classes say the same in one row per
    document.
    """
    members = cut(look_classes(documents), "look-members")
    a = members.select("class_id", F.col("doc_id").alias("doc_a"), F.col("spelling_id").alias("_a"))
    b = members.select("class_id", F.col("doc_id").alias("doc_b"), F.col("spelling_id").alias("_b"))
    return a.join(b, "class_id").where("doc_a < doc_b AND _a <> _b").select("doc_a", "doc_b").distinct()
