"""Predicates and classifications as built-in column expressions; a value column is binary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File signatures, in the order in which they are tried: name, then (offset, hex) pairs that must all agree.
SIGNATURES = (
    ("pe", ((1, "4D5A"),)),
    ("elf", ((1, "7F454C46"),)),
    ("macho", ((1, "FEEDFACE"),)),
    ("macho", ((1, "CEFAEDFE"),)),
    ("macho", ((1, "FEEDFACF"),)),
    ("macho", ((1, "CFFAEDFE"),)),
    ("png", ((1, "89504E470D0A1A0A"),)),
    ("jpeg", ((1, "FFD8FF"),)),
    ("gif", ((1, "474946383961"),)),
    ("gif", ((1, "474946383761"),)),
    ("bmp", ((1, "424D"),)),
    ("webp", ((1, "52494646"), (9, "57454250"))),
    ("wav", ((1, "52494646"), (9, "57415645"))),
    ("avi", ((1, "52494646"), (9, "41564920"))),
    ("zip", ((1, "504B0304"),)),
    ("gz", ((1, "1F8B"),)),
    ("bz2", ((1, "425A68"),)),
    ("xz", ((1, "FD377A585A00"),)),
    ("zstd", ((1, "28B52FFD"),)),
    ("rar", ((1, "526172211A0700"),)),
    ("rar", ((1, "526172211A070100"),)),
    ("pdf", ((1, "25504446"),)),
    ("mp3", ((1, "494433"),)),
    ("mp3", ((1, "FFFB"),)),
    ("mp3", ((1, "FFF3"),)),
    ("flac", ((1, "664C6143"),)),
    ("aac", ((1, "FFF1"),)),
    ("aac", ((1, "FFF9"),)),
    ("ogg", ((1, "4F676753"),)),
    ("mp4", ((5, "66747970"),)),
    ("mkv", ((1, "1A45DFA3"),)),
)
IMAGES, VIDEOS = ("jpeg", "png", "gif", "bmp", "webp"), ("mp4", "mkv", "avi")
ARCHIVES, TEXTS, PROGRAMS = ("zip", "gz", "bz2", "xz", "zstd", "rar"), ("ascii", "utf8"), ("elf", "pe", "macho")
#: Hex of bytes 20-7E, 09, 0A, 0D only; and of a first valid UTF-8 character.
ASCII_HEX = "^(?:[2-6].|7[0-9A-E]|09|0A|0D)+$"
UTF8_HEX = (
    "^(?:[0-7].|(?:C[2-9A-F]|D.)[89AB].|E0[AB].[89AB].|(?:E[1-9ABCEF])(?:[89AB].){2}|ED[89].[89AB].|F0[9AB].(?:[89AB].){2}|F[1-3](?:[89AB].){3}|F48.(?:[89AB].){2})"
)
NUL_HEX = "^(?:..)*?00"


def _part(value: Column, at: int, n: int) -> Column:
    return F.substring(value, at, n)


def is_ascii(value: Column) -> Column:
    """Printable ASCII, tab, line feed and carriage return in the first 256 bytes, and not empty."""
    return F.hex(_part(value, 1, 256)).rlike(ASCII_HEX)


def signature(value: Column) -> Column:
    """The first signature that agrees, else "ascii", "utf8" (a valid first character and no NUL in the
    first 256 bytes) or "unknown"; null for null."""
    head = F.hex(_part(value, 1, 256))
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for name, parts in SIGNATURES:
        test = F.lit(True)
        for at, code in parts:
            test &= F.substring(head, 2 * at - 1, len(code)) == code
        out = out.when(test, name)
    return out.when(head.rlike(ASCII_HEX), "ascii").when(~head.rlike(NUL_HEX) & head.rlike(UTF8_HEX), "utf8").otherwise("unknown")


def _number(value: Column, at: Column | int, n: int, big: bool = False) -> Column:
    """An unsigned number of n bytes at a 1-based position; null beyond the end."""
    code = F.hex(F.substring(value, at, n) if isinstance(at, int) else value.substr(at, F.lit(n)))
    pairs = [F.substring(code, 2 * i + 1, 2) for i in range(n)]
    ordered = F.concat(*(pairs if big else pairs[::-1]))
    return F.when(F.length(code) == 2 * n, F.conv(ordered, 16, 10).cast("long"))


def is_x86_program(value: Column) -> Column:
    """A PE with a PE header, or an ELF or Mach-O file for x86 or x86-64."""
    size = F.length(value)
    offset = _number(value, 61, 4)
    pe = (size >= 64) & (F.hex(_part(value, 1, 2)) == "4D5A") & (offset + 4 <= size) & (F.hex(value.substr((offset + 1).cast("int"), F.lit(4))) == "50450000")
    order = F.hex(_part(value, 6, 1))
    machine = F.hex(_part(value, 19, 2))
    elf = (
        (size >= 20) & (F.hex(_part(value, 1, 4)) == "7F454C46") & F.hex(_part(value, 5, 1)).isin("01", "02")
        & ((order == "01") & machine.isin("0300", "3E00") | (order == "02") & machine.isin("0003", "003E"))
    )
    magic, cpu = F.hex(_part(value, 1, 4)), F.hex(_part(value, 5, 4))
    macho = magic.isin("FEEDFACE", "FEEDFACF") & cpu.isin("00000007", "01000007") | magic.isin("CEFAEDFE", "CFFAEDFE") & cpu.isin("07000000", "07000001")
    return F.coalesce(pe, F.lit(False)) | F.coalesce(elf, F.lit(False)) | F.coalesce(macho, F.lit(False))


def incompressible(entropy: Column) -> Column:
    return entropy > 7.95


def compression_estimate(entropy: Column) -> Column:
    return F.least(F.greatest(entropy / 8, F.lit(0.0)), F.lit(1.0))


def routing(signature: Column, entropy: Column, stride: Column, program: Column, n_bytes: Column) -> Column:
    """struct(content_type, pipeline, stride_hint, window, confidence, estimated_ratio), first rule first.

    Values under 64,536 bytes have confidence 0.95 throughout."""
    small = n_bytes < 64_536
    ratio = compression_estimate(entropy)

    def rule(content: str, pipeline: str, hint: Column | None, window: int, confidence: float, estimate: Column | float, fixed: bool = False) -> Column:
        sure = F.lit(confidence) if fixed else F.when(small, 0.95).otherwise(confidence)
        return F.struct(
            F.lit(content).alias("content_type"),
            F.lit(pipeline).alias("pipeline"),
            (hint if hint is not None else F.lit(None)).cast("int").alias("stride_hint"),
            F.lit(window).alias("window"),
            sure.cast("double").alias("confidence"),
            (estimate if isinstance(estimate, Column) else F.lit(estimate)).cast("double").alias("estimated_ratio"),
        )

    raw = lambda c: rule("incompressible", "store_raw", None, 0, c, 1.0)
    return (
        F.when(program, rule("executable", "binary", None, 262_144, 0.95, 0.7, True))
        .when(signature.isin(*IMAGES) & (entropy > 7.0), raw(0.9))
        .when(signature.isin(*VIDEOS) & (entropy > 6.5), raw(0.9))
        .when(signature.isin(*ARCHIVES), raw(0.95))
        .when(incompressible(entropy), raw(0.99))
        .when(signature.isin("wav", "flac") | stride.isNotNull() & (signature == "unknown"), rule("multimedia", "multimedia", stride, 131_072, 0.85, ratio))
        .when(signature.isin(*TEXTS) | (entropy < 4.5) & (signature != "unknown"), rule("text", "text", None, 65_536, 0.9, ratio))
        .when(signature.isin(*PROGRAMS) | entropy.between(4.5, 6.5), rule("binary", "binary", stride, 262_144, 0.8, ratio))
        .otherwise(rule("binary", "binary", stride, 262_144, 0.5, ratio))
    )


def block_type(content_type: Column, pipeline: Column) -> Column:
    """raw, text, multimedia or binary; a missing classification counts as binary."""
    return (
        F.when((pipeline == "store_raw") | (content_type == "incompressible"), "raw").when(content_type == "text", "text").when(content_type == "multimedia", "multimedia").otherwise("binary")
    )


#: Order of the groups of blocks in an archive.
BLOCK_ORDER = ("text", "multimedia", "binary", "raw", "mixed")


def block_rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, BLOCK_ORDER)), kind)


def context_allowed(kind: Column, media_filter: Column) -> Column:
    return kind.isin("text", "binary", "mixed") & media_filter.isin("none", "bcj_x86")


def password_strength(password: Column) -> Column:
    """weak, moderate, strong or very_strong by length in UTF-8 bytes and variety; null for null."""
    n = F.length(password.cast("binary"))
    kinds = [password.rlike(p).cast("int") for p in (r"\p{Lu}", r"\p{Ll}", r"\p{N}", r"[^\p{L}\p{N}]")]
    varied = kinds[0] + kinds[1] + kinds[2] + kinds[3] >= 3
    return (
        F.when(password.isNull(), F.lit(None).cast("string")).when(n < 8, "weak").when(n >= 20, "very_strong")
        .when(n >= 12, F.when(varied, "strong").otherwise("moderate")).when(varied, "moderate").otherwise("weak")
    )


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; null without one, or for a name that only begins with a dot."""
    name = F.regexp_extract(path, "[^/]*$", 0)
    return F.when(name.rlike(r"^.+\.[^.]*$") & ~name.isin(".", ".."), F.regexp_extract(name, r"\.([^.]*)$", 1))


def distance_slot(distance: Column) -> Column:
    """struct(slot, extra_value, extra_bits) of a match distance from 1."""
    d = distance.cast("long") - 1
    top = F.length(F.bin(d)) - 1
    slot = F.when(d < 4, d.cast("int")).otherwise(F.least(2 * top + (F.substring(F.bin(d), 2, 1) == "1").cast("int"), F.lit(55)))
    half = F.floor(slot / 2).cast("int")
    base = F.when(slot < 4, slot + 1).otherwise(F.pow(F.lit(2.0), half) + F.pmod(slot, F.lit(2)) * F.pow(F.lit(2.0), half - 1) + 1).cast("long")
    bits = F.when(slot < 4, 0).otherwise(F.floor((slot - 2) / 2)).cast("int")
    return F.struct(slot.cast("int").alias("slot"), (distance.cast("long") - base).alias("extra_value"), bits.alias("extra_bits"))
