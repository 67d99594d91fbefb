"""Signals a reviewer looks for in untrusted text: commands, hidden text, front matter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import let, sums_before

# File classes.
TEXT_EXTENSIONS = (
    ".md", ".mdx", ".mdc", ".txt", ".json", ".yaml", ".yml", ".toml",
    ".ts", ".tsx", ".js", ".jsx", ".py", ".sh", ".bash", ".zsh",
    ".rb", ".go", ".rs", ".java", ".kt", ".swift",
    ".html", ".css", ".ini", ".env", ".cfg", ".conf",
)
SUSPICIOUS_EXTENSIONS = (".so", ".dylib", ".dll", ".node", ".exe", ".wasm", ".bin")

# Fixed values: (name, pattern) of the high-risk command signals, in order.
COMMAND_SIGNALS = (
    ("rm -rf /", r"(?i)rm\s+-rf\s+/(?!\w)"),
    ("sudo rm", r"(?i)sudo\s+rm"),
    ("curl | sh", r"(?i)curl[^|]*\|\s*(?:ba)?sh"),
    ("wget | sh", r"(?i)wget[^|]*\|\s*(?:ba)?sh"),
    ("iwr | iex", r"(?i)iwr[^|]*\|\s*iex"),
    ("eval()", r"(?i)eval\s*\("),
    ("exec()", r"(?i)exec\s*\("),
    ("new Function(...)", r"Function\s*\(\s*['\"`]"),
    ("chmod 777", r"(?i)chmod\s+777"),
    ("fork bomb", r":\(\)\{\s*:\|:&\s*\};:"),
    ("dd to device", r"(?i)dd\s+if=/dev/(?:zero|random)\s+of=/dev"),
    ("mkfs (format)", r"(?i)\bmkfs(?:\.\w+)?\b"),
    ("base64 decode | sh", r"(?i)base64\s+-d[^|]*\|\s*(?:ba)?sh"),
    ("persistence primitive", r"(?i)\b(?:crontab|systemctl|launchctl)\s+(?:-e|edit|enable|load)"),
)
# The shorter list the quick scan uses.
QUICK_COMMAND_SIGNALS = (
    ("rm -rf /", r"(?i)rm\s+-rf\s+/(?!\w)"),
    ("sudo rm", r"(?i)sudo\s+rm"),
    ("curl | sh", r"(?i)curl[^|]*\|\s*(?:ba)?sh"),
    ("wget | sh", r"(?i)wget[^|]*\|\s*(?:ba)?sh"),
    ("eval()", r"(?i)eval\s*\("),
    ("exec()", r"(?i)exec\s*\("),
    ("chmod 777", r"(?i)chmod\s+777"),
    ("fork bomb", r":\(\)\{\s*:\|:&\s*\};:"),
    ("dd to device", r"(?i)dd\s+if=/dev/(?:zero|random)\s+of=/dev"),
    ("mkfs (format)", r"(?i)mkfs"),
    ("base64 decode | sh", r"(?i)base64\s+-d[^|]*\|\s*(?:ba)?sh"),
)

# Hidden-text patterns.
ZERO_WIDTH = r"[\x{200B}-\x{200F}\x{2060}\x{FEFF}]"
BIDI = r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]"
BASE64_BLOB = r"[A-Za-z0-9+/]{200,}={0,2}"
HEX_ROPE = r"(?:\\x[0-9a-fA-F]{2}){8,}"
HTML_IMPERATIVE = (
    r"(?iU)<!--[\s\S]{0,400}?\b(?:ignore|disregard|pretend|you are|system:|assistant:)\b[\s\S]{0,400}?-->"
)
HARD_KINDS = ("bidi-override", "html-comment-imperative")
SOFT_KINDS = ("zero-width-char", "base64-blob", "hex-escape-rope")

SIGNAL_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("name", T.StringType()),
            T.StructField("line", T.IntegerType()),
            T.StructField("sample", T.StringType()),
        ]
    )
)


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def placed(text: Column, pattern: str) -> Column:
    """Array of (match, line) over a whole text; line = newlines before it, plus 1."""
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
        F.transform(F.split(text, pattern, -1), _newlines).alias("gap"),
    )

    def lines(p: Column) -> Column:
        step = F.zip_with(p["gap"], p["m"], lambda g, m: g + F.coalesce(_newlines(m), F.lit(0)))

        def hit(before: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                return F.struct(m.alias("match"), (F.get(before, i) + F.get(p["gap"], i) + 1).cast("int").alias("line"))

            return F.transform(p["m"], one)

        return let(step, lambda s: let(sums_before(s), hit))

    return let(parts, lines)


def _signals(text: Column, pattern: str, kind: str, name, sample) -> Column:
    java = pattern if pattern.startswith("(?iU)") else "(?dU)" + pattern
    found = F.transform(
        placed(text, java),
        lambda h: F.struct(
            F.lit(kind).alias("kind"),
            F.lit(name).cast("string").alias("name"),
            h["line"].alias("line"),
            sample(h["match"]).cast("string").alias("sample"),
        ),
    )
    return F.when(text.rlike(java), found).otherwise(F.array().cast(SIGNAL_TYPE))


def command_signals(text: Column, table=COMMAND_SIGNALS) -> Column:
    """All high-risk command signals of a text, by signal then offset."""
    return F.flatten(
        F.array(*[_signals(text, p, "command", n, lambda m: F.lit(None)) for n, p in table])
    )


def _first_character(text: Column, pattern: str, kind: str) -> Column:
    before = F.element_at(F.split(text, pattern, 2), 1)
    found = F.regexp_extract(text, pattern, 0)
    signal = F.struct(
        F.lit(kind).alias("kind"),
        F.lit(None).cast("string").alias("name"),
        (_newlines(before) + 1).cast("int").alias("line"),
        F.format_string("U+%04X", F.ascii(found)).alias("sample"),
    )
    return F.when(text.rlike(pattern), F.array(signal)).otherwise(F.array().cast(SIGNAL_TYPE))


def obfuscation_signals(text: Column) -> Column:
    """Hidden characters (first hit only), blobs and comments that give orders."""

    def size(m: Column) -> Column:
        return F.concat(F.length(m).cast("string"), F.lit(" chars"))

    def squeezed(m: Column) -> Column:
        return F.substring(F.regexp_replace(m, r"(?U)[\s\x1c-\x1f]+", " "), 1, 80)

    return F.concat(
        _first_character(text, ZERO_WIDTH, "zero-width-char"),
        _first_character(text, BIDI, "bidi-override"),
        _signals(text, BASE64_BLOB, "base64-blob", None, size),
        _signals(text, HEX_ROPE, "hex-escape-rope", None, size),
        _signals(text, HTML_IMPERATIVE, "html-comment-imperative", None, squeezed),
    )


# Cheap test that is true for every text with a command or hidden-text signal.
SIGNAL_PRETEST = (
    r"(?iU)rm\s+-rf|sudo\s+rm|curl|wget|iwr|eval\s*\(|exec\s*\(|function\s*\(|chmod\s+777|:\(\)\{"
    r"|dd\s+if=|mkfs|base64\s+-d|crontab|systemctl|launchctl|<!--|\\x[0-9a-f]{2}|" + ZERO_WIDTH
    + "|" + BIDI + r"|[A-Za-z0-9+/]{200}"
)


def front_matter(text: Column) -> Column:
    """Map of the leading ``---`` block; outer quotes dropped, the last key wins.

    Needs ``spark.sql.mapKeyDedupPolicy=LAST_WIN``.
    """
    block = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---", 1)
    rows = F.filter(F.split(block, r"\r\n|[\n\r]", -1), lambda r: r.rlike(r"^[A-Za-z0-9_-]+:"))

    def entry(row: Column) -> Column:
        value = F.trim(F.regexp_extract(row, r"(?s)^[A-Za-z0-9_-]+:(.*)$", 1), F.lit(" \t\r\f\v"))
        bare = F.when(
            (value.startswith('"') & value.endswith('"')) | (value.startswith("'") & value.endswith("'")),
            F.substr(value, F.lit(2), F.greatest(F.length(value) - 2, F.lit(0))),
        ).otherwise(value)
        return F.struct(F.regexp_extract(row, r"^([A-Za-z0-9_-]+):", 1).alias("k"), bare.alias("v"))

    return F.map_from_entries(F.transform(rows, entry))


def list_field(raw: Column) -> Column:
    """``[a, b]`` or a comma or space separated list as an array; empty is NULL."""
    t = F.trim(raw)
    bracketed = t.startswith("[") & t.endswith("]")
    inner = F.substr(t, F.lit(2), F.greatest(F.length(t) - 2, F.lit(0)))
    items = F.when(
        bracketed, F.transform(F.split(inner, ","), lambda x: F.trim(x))
    ).otherwise(F.split(t, r"[,\s]+"))
    return F.when((raw.isNotNull()) & (raw != ""), F.filter(items, lambda x: x != ""))


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; names that only start with a dot have none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def inventory_class(
    path: Column, size: Column, content: Column, max_bytes: int | None = None, sniff_bytes: int | None = None
) -> Column:
    """Struct (kind, suspicious): text, or binary with the reasons to worry.

    The whole content is looked at unless ``sniff_bytes`` says otherwise, and
    files of any size unless ``max_bytes`` does.
    """
    ext = extension(path)
    unread = ext.isin(*SUSPICIOUS_EXTENSIONS)
    if max_bytes is not None:
        unread = unread | (size > max_bytes)
    looked_at = content if sniff_bytes is None else F.substring(content, 1, sniff_bytes)
    has_nul = F.position(F.lit(b"\x00"), looked_at) > 0

    def cls(kind: str, suspicious) -> Column:
        return F.struct(F.lit(kind).alias("kind"), suspicious.alias("suspicious"))

    return (
        F.when(unread, cls("binary", F.lit(True)))
        .when(has_nul, cls("binary", ~ext.isin(*TEXT_EXTENSIONS)))
        .otherwise(cls("text", F.lit(False)))
    )
