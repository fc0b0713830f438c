"""Names of files and what they say: extensions and kinds, places that are noise, keys of stored objects, and texts of documents."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions by kind of document. Fixed values.
KINDS = {
    "PDF": "pdf",
    "WORD": "doc dot docx docm dotx odt ott rtf epub",
    "SLIDES": "ppt pps pptx pptm ppsx potx odp otp odg",
    "SPREADSHEET": "xls xlt xlsx xlsm xltx ods ots csv tsv",
    "TEXT": "txt md markdown json xml yaml yml log",
    "IMAGE": "png jpg jpeg gif webp bmp tif tiff heic heif avif svg",
    "ARCHIVE": "zip",
}
#: Containers that a kind of document may come in, beside its own. Fixed values.
CONTAINERS = {"ARCHIVE": ("ARCHIVE", "WORD", "SLIDES", "SPREADSHEET"), "WORD": ("WORD", "SLIDES", "SPREADSHEET")}
_ENTITY = re.compile(r"&(lt|gt|quot|apos|amp|#\d+|#x[0-9a-fA-F]+);")
#: Named entities. Fixed values.
_NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}


def extension(name: Column) -> Column:
    """The extension in lower case; none where the only dot begins or ends the name."""
    base = F.element_at(F.split(name, "/"), -1)
    found = F.regexp_extract(base, r"(?s)^.+\.([^.]+)$", 1)
    return F.lower(found)


def kind_of(ext: Column) -> Column:
    """The kind of document of an extension, or UNKNOWN."""
    out = F.when(F.lit(False), F.lit(""))
    for kind, held in KINDS.items():
        out = out.when(ext.isin(*held.split()), kind)
    return out.otherwise("UNKNOWN")


def signature_fits(ext: Column, sniffed: Column, executable: Column) -> Column:
    """Whether a file of this extension may begin as it does: ``sniffed`` is the kind by its first bytes, null where they tell nothing."""
    kind = kind_of(F.lower(ext))
    bare = (F.lower(ext) == "svg") | kind.isin("TEXT", "SPREADSHEET", "WORD")
    held = kind == sniffed
    for container, kinds in CONTAINERS.items():
        held = F.when(sniffed == container, kind.isin(*kinds)).otherwise(held)
    return F.when((kind == "UNKNOWN") | executable, False).when(sniffed.isNull(), bare).when(kind == "TEXT", False).otherwise(held)


def is_noise(path: Column) -> Column:
    """Whether an archive's entry is what systems leave there, and no document."""
    parts = F.split(path, "/")
    left = F.arrays_overlap(parts, F.array(F.lit(".DS_Store"), F.lit("Thumbs.db")))
    return path.startswith("__MACOSX/") | path.contains("/__MACOSX/") | left | F.element_at(parts, -1).startswith("._")


def page_key(workspace: Column, version: Column, page: Column) -> Column:
    """Where the image of a page is stored."""
    return F.concat(F.lit("previews/"), workspace, F.lit("/"), version, F.lit("/pages/"), F.lpad(page.cast("string"), 5, "0"), F.lit(".webp"))


def key_segment(text: str) -> str:
    """A text as one segment of a key: ASCII letters, digits, dots, underscores and single dashes, 120 at most."""
    bare = re.sub(r"-{2,}", "-", re.sub(r"[^\w.-]+", "-", unicodedata.normalize("NFKD", text), flags=re.ASCII))
    return re.sub(r"^[-.]+|[-.]+$", "", bare)[:120].lower()


def decoded(text: str) -> str:
    """A text of XML with its entities as characters; ones that name no character stay."""

    def char(found: re.Match) -> str:
        name = found[1]
        code = int(name[2:], 16) if name.startswith("#x") else int(name[1:]) if name[0] == "#" else None
        if code is None:
            return _NAMED[name]
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else found[0]

    return _ENTITY.sub(char, text)


def word_set(text: str) -> set[str]:
    """The words of three characters or more, without case and accents."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not 0x300 <= ord(c) <= 0x36F)
    return {w for w in re.split(r"[\W_]+", bare) if len(w) > 2}


def _mapped(kind: str, make):
    @F.arrow_udf(kind)
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if x is None else make(x) for x in batch.to_pylist()], pa.string())

    return apply


def xml_text(text: Column) -> Column:
    return _mapped("string", decoded)(text)


def object_key(prefix: str, *parts: Column, name: Column) -> Column:
    """The key of a stored file below its owners; a name without a usable character is file."""
    segment = _mapped("string", lambda x: key_segment(x) or "file")(name)
    return F.concat_ws("/", F.lit(prefix), *parts, segment)


def text_consistency(source: Column, preview: Column) -> Column:
    """The share of the source's words that the preview shows; 1 where it has none."""

    @F.arrow_udf("double")
    def apply(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for own, shown in batches:
            out = []
            for a, b in zip(own.to_pylist(), shown.to_pylist()):
                words = word_set(a or "")
                out.append(len(words & word_set(b or "")) / len(words) if words else 1.0)
            yield pa.array(out, pa.float64())

    return apply(source, preview)


def append_capped(held: Column, new: Column, most: int = 5) -> Column:
    """The first ``most`` of the values held and the new ones."""
    return F.slice(F.concat(held, new), 1, most)
