"""Payload expressions. Everything is computed inside the row, so nothing is exploded or shuffled."""

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficlens import dims

# Java's \b also treats accented letters as word characters; attack payloads are bytes.
_WORD_EDGE = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
# Plain characters, a class, an escape, a named group, a reference to one, or anything else.
_PARTS = re.compile(r"[^\\\[(]+|\[\^?\]?(?:\\.|[^\]\\])*\]|\\.|\(\?P<(\w+)>|\(\?P=(\w+)\)|.", re.S)


def java_regex(pattern: str, flags: str = "is") -> str:
    """Pattern in Python byte-regex syntax rewritten for Java, with ``i`` and/or ``s`` flags."""
    names: dict[str, str] = {}

    def rewritten(m: re.Match) -> str:
        if m[1]:
            return f"(?<{names.setdefault(m[1], f'g{len(names)}')}>"
        if m[2]:
            return f"\\k<{names.get(m[2], m[2])}>"
        if m[0].startswith("["):
            # Java nests classes and intersects them; Python takes these characters as they are.
            body = m[0][1:-1]
            first = re.match(r"\^?\]?", body)[0]
            return "[" + first.replace("]", "\\]") + re.sub(r"\\.|[\[&]", lambda c: {"\\b": "\\x08"}.get(c[0], c[0] if len(c[0]) > 1 else "\\" + c[0]), body[len(first):], flags=re.S) + "]"
        return {"\\Z": "\\z", "\\b": _WORD_EDGE}.get(m[0], m[0])

    # "d": only \n ends a line, for "$" too.
    return f"(?{flags}d){_PARTS.sub(rewritten, pattern)}"


def payload_bytes(payload: Column, data_type: T.DataType | None = None) -> Column:
    """Bytes of a text, binary or structured payload (structures are written as JSON first)."""
    if isinstance(data_type, T.BinaryType):
        return payload
    if isinstance(data_type, (T.StructType, T.ArrayType, T.MapType)):
        payload = F.to_json(payload)
    return F.encode(payload, "UTF-8")


def byte_text(data: Column) -> Column:
    """One character per byte, so that patterns and counts work on bytes."""
    return F.decode(data, "ISO-8859-1")


def payload_text(payload: Column, data_type: T.DataType | None = None) -> Column:
    """Byte text of a payload; NULL when it is missing or empty."""
    data = payload_bytes(payload, data_type)
    return byte_text(F.when(F.octet_length(data) > 0, data))


def distinct_bytes(text: Column) -> Column:
    """Distinct characters of a byte text, in order of first occurrence."""
    return F.array_distinct(F.split(text, ""))


def octets_left(text: Column, chars: Column) -> Column:
    """Octets left before each character is removed in turn. The text shrinks, so later steps get cheap."""
    start = F.struct(text.alias("rest"), F.array().cast("array<int>").alias("left"))

    def remove(acc: Column, c: Column) -> Column:
        rest = F.replace(acc["rest"], c, F.lit("")).alias("rest")
        return F.struct(rest, F.array_append(acc["left"], F.octet_length(acc["rest"])).alias("left"))

    return F.aggregate(chars, start, remove, lambda acc: acc["left"])


def byte_counts(chars: Column, left: Column) -> Column:
    """One number per distinct byte, ``n * 256 + 255 - byte``: sorted downwards, frequent and small bytes come first."""

    def counted(c: Column, i: Column) -> Column:
        removed = F.get(left, i) - F.coalesce(F.get(left, i + 1), F.lit(0))
        # Bytes above 127 take two octets in the text.
        n = F.call_function("div", removed, F.octet_length(c))
        return n * 256 + (255 - F.ascii(c))

    return F.transform(chars, counted)


def entropy(counts: Column, size: Column) -> Column:
    """Shannon entropy in bits per byte from byte counts."""

    def add(acc: Column, count: Column) -> Column:
        n = F.shiftright(count, 8)
        return acc + n * F.log2(n)

    return F.log2(size) - F.aggregate(counts, F.lit(0.0), add) / size


def printable_ratio(text: Column) -> Column:
    """Share of bytes 32..126."""
    return F.length(F.regexp_replace(text, "[^ -~]", "")) / F.length(text)


def byte_frequency(counts: Column, size: Column, top: int = 10) -> Column:
    """Map from hexadecimal byte to its share, for the ``top`` most frequent bytes."""
    ranked = F.slice(F.sort_array(counts, asc=False), 1, top)

    def entry(count: Column) -> Column:
        byte = 255 - count.bitwiseAND(255)
        return F.struct(F.concat(F.lit("0x"), F.lower(F.hex(byte))), F.shiftright(count, 8) / size)

    return F.map_from_entries(F.transform(ranked, entry))


def _any_of(text: Column, *literals: str) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(x) for x in literals])


def content_tests(text: Column, lower: Column) -> dict[str, Column]:
    """The tests of ``dims.CONTENT_PATTERNS``, with substring searches in place of patterns where they suffice.

    ``lower`` is the lower-case text. It spares case-insensitive matching; bytes above 127 are left to ``text``.
    """
    return {
        "http": _any_of(lower, "get", "post", "put", "delete", "head", "options", "connect", "trace")
        | (lower.contains("http/") & lower.rlike(r"http/\d\.\d")),
        "dns": text.contains("\x00\x01\x00\x00\x01"),
        "ssh": lower.contains("ssh-") & lower.rlike(r"ssh-\d\.\d"),
        "ftp": lower.contains("230 login successful") | (lower.contains(" ftp") & lower.rlike(r"220 [^\n]* ftp")),
        "smtp": _any_of(lower, "ehlo", "helo", "mail from", "rcpt to")
        | (lower.contains(" smtp") & lower.rlike(r"220 [^\n]* smtp")),
        "ssl": (text.contains("\x16\x03") & text.rlike(r"\x16\x03[\x00-\x03]")) | text.contains("\x16\xfe\xff"),
        "json": text.rlike(r"\A\s*+\{") & text.rlike(r"\}\s*+\z"),
        "xml": lower.rlike(r"\A\s*+<(?:\?xml|[a-z0-9])"),
    }


def content_type(text: Column, lower: Column) -> Column:
    kind = F.when(text.isNull(), "unknown")
    for name, test in content_tests(text, lower).items():
        kind = kind.when(test, name)
    return kind.when(printable_ratio(text) > 0.8, "text").otherwise("binary")


_WORD = "a-z0-9_"


def _word(*words: str) -> str:
    return rf"(?<![{_WORD}])(?:{'|'.join(words)})(?![{_WORD}])"


def signature_flags(lower: Column) -> dict[str, Column]:
    """One boolean per built-in signature, False without payload.

    Each is equal to searching the pattern of ``dims.ATTACK_SIGNATURES`` in the payload, but runs in linear
    time: substring searches come first, and patterns of the form "A, later B" are anchored and atomic, since
    the first A (and the first B after it) decides. Searching the plain patterns restarts at every ``<``.
    """
    verbs = ("select", "update", "insert", "delete", "drop", "alter", "union")
    nouns = ("from", "table", "where")
    has = lower.contains
    tests = {
        "sql_injection": (
            _any_of(lower, *verbs) & _any_of(lower, *nouns) & lower.rlike(rf"(?s)\A(?>.*?{_word(*verbs)}).*?{_word(*nouns)}")
        )
        | has("%27")
        | (has("'") & lower.rlike(r"'\s*+(?:--|#|/\*|\z)")),
        "xss": has("<")
        & (
            (has("<script") & has("</script>") & lower.rlike(r"(?s)\A(?>.*?<script)(?>.*?>).*?</script>"))
            | (has("javascript:") & lower.rlike(r"(?s)\A[^<]*+<(?>.*?javascript:).*>"))
            | (has("onmouse") & lower.rlike(r"(?s)\A[^<]*+<(?>.*?onmouse).*>"))
            | (has("on") & has("=") & lower.rlike(rf"(?s)\A[^<]*+<(?>.*?on[{_WORD}]++\s*+=).*>"))
        ),
        "command_injection": _any_of(lower, "/bin/", "/etc/", "/usr/", "/tmp/")
        & lower.rlike(r"(?s)\A(?>.*?(?:[;|`]|\$\(|\$\{)).*?/(?:bin|etc|usr|tmp)/"),
        "path_traversal": _any_of(lower, "../", "..\\"),
        "file_inclusion": has("=")
        & has("../")
        & lower.rlike(r"(?:\A|\n)(?>[^\n=]*=)(?>[^\n]*?\.\./)[^\n]*?\.(?:php|asp|jsp)"),
        "denial_of_service": _any_of(lower, "slowloris", "r-u-dead-yet", "torshammer"),
        "malware_communication": _any_of(lower, "botnet", "backdoor", "trojan", "ransomware"),
        "sensitive_data": _any_of(
            lower, "password=", "passwd=", "pwd=", "creditcard=", "credit_card=", "cc=", "ssn=", "socialsecurity=",
            "social_security=",
        ),
    }
    return {name: F.coalesce(test, F.lit(False)) for name, test in tests.items()}


def payload_features(text: Column, kind: Column, flags: list[Column], hits: Column, counts: Column) -> Column:
    """The 20 payload features from already computed parts; zeros without payload."""
    size = F.length(text)
    features = [entropy(counts, size), printable_ratio(text), size, hits, *flags]
    features += [kind == name for name in dims.CONTENT_PATTERNS]
    return F.when(text.isNotNull(), F.array(*[f.cast("double") for f in features])).otherwise(
        F.array_repeat(F.lit(0.0), len(features))
    )
