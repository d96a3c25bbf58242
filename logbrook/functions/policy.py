"""What may be collected: hard-deny paths, path checks, sizes, binary content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import basename

# Limits.
MAX_FILE_BYTES = 10 * 1024 * 1024
MAX_PAYLOAD_BYTES = 50 * 1024 * 1024
MAX_MEMBERS = 100
MAX_EVENTS = 200
MAX_FIELD_CHARS = 16 * 1024
MAX_JSONL_BYTES = 1024 * 1024
MAX_EVIDENCE = 20
MAX_COMPRESSION_RATIO = 100
MAX_NAME_BYTES = 240
MAX_PATH_CHARS = 4096
SNIFF_BYTES = 8192

# Reasons and expressions for paths before they are read; the first that fits counts.
DENY: tuple[tuple[str, str], ...] = (
    ("SSH directory", r"(^|/)\.ssh/"),
    ("AWS credentials", r"(^|/)\.aws/"),
    ("Azure credentials", r"(^|/)\.azure/"),
    ("GCloud credentials", r"(^|/)\.config/gcloud/"),
    ("GSutil credentials", r"(^|/)\.config/gsutil/"),
    ("OCI credentials", r"(^|/)\.config/oci/"),
    ("GPG directory", r"(^|/)\.gnupg/"),
    ("Password store", r"(^|/)\.password-store/"),
    ("Agent credentials", r"(^|/)\.claude/credentials|(^|/)\.codex/config|(^|/)\.config/opencode/credentials"),
    ("Git credentials file", r"(^|/)\.git-credentials$"),
    ("Git config", r"(^|/)\.gitconfig$"),
    ("Netrc", r"(^|/)\.netrc$"),
    ("PGPass", r"(^|/)\.pgpass$"),
    ("My.cnf", r"(^|/)\.my\.cnf$"),
    ("Npmrc", r"(^|/)\.npmrc$"),
    ("PyPirc", r"(^|/)\.pypirc$"),
    ("Bash history", r"(^|/)\.bash_history$"),
    ("Zsh history", r"(^|/)\.zsh_history$"),
    ("Python history", r"(^|/)\.python_history$"),
    ("Fish history", r"(^|/)\.local/share/fish/fish_history$"),
    ("Shell history (legacy)", r"(^|/)\.history$"),
    ("Browser cookies", r"(^|/)Cookies$|(^|/)Cookies\.db$|(^|/)logins\.json$|(^|/)Login Data$"),
    ("Environment/credential files", r"(^|/)\.env$|(^|/)\.env\.[^. ]+|(^|/)\.envrc$|(^|/)credentials$|(^|/)\.credentials$|(^|/)secrets\.yml$|(^|/)secrets\.yaml$|(^|/)vault\.yml$|(^|/)vault\.yaml$"),
    ("Private key extensions", r"\.pem$|\.key$|\.cert$|\.p12$|\.pfx$|\.age$|\.enc$|\.encrypted$"),
)

# The shorter list for paths inside a finished bundle.
ARCHIVE_DENY: tuple[tuple[str, str], ...] = (
    ("SSH directory", r"(^|/)\.ssh/"),
    ("AWS credentials", r"(^|/)\.aws/"),
    ("Azure credentials", r"(^|/)\.azure/"),
    ("GPG directory", r"(^|/)\.gnupg/"),
    ("Git credentials", r"(^|/)\.git-credentials$"),
    ("Git config", r"(^|/)\.gitconfig$"),
    ("Netrc", r"(^|/)\.netrc$"),
    ("Env file", r"(^|/)\.env$"),
    ("Env var file", r"(^|/)\.env\.[^.]+$"),
    ("Private key", r"\.pem$|\.key$|\.cert$"),
    ("Credentials file", r"(^|/)credentials$"),
    ("Secrets file", r"(^|/)secrets\.(yml|yaml)$"),
    ("Vault file", r"(^|/)vault\.(yml|yaml)$"),
    ("Shell history", r"(^|/)\.(bash|zsh|python)_history$"),
)


def denied(path: Column, rules=DENY) -> Column:
    """The reason of the first rule that fits the path or its last part; else null."""
    name = basename(path)
    return F.coalesce(*[F.when(path.rlike(regex) | name.rlike(regex), F.lit(reason)) for reason, regex in rules])


def inside(path: Column, root: str) -> Column:
    """Whether the path is the root or lies under it; a sibling with the same beginning does not."""
    root = root.rstrip("/")
    return (path == root) | path.startswith(root + "/")


def path_code(path: Column, root: str | None = None, exists: Column | None = None, is_dir: Column | None = None, is_file: Column | None = None) -> Column:
    """The error code of the first check that fails, else null; file facts come as columns where they are known."""
    code = F.when(path.contains("\0"), "E_POLICY_NUL")
    if exists is not None:
        code = code.when(~exists, "E_POLICY_NOT_FOUND")
    if is_dir is not None:
        code = code.when(is_dir, "E_POLICY_DIR")
    if is_file is not None:
        code = code.when(~is_file, "E_POLICY_SPECIAL")
    code = code.when(F.length(path) > MAX_PATH_CHARS, "E_POLICY_PATH_LENGTH")
    if root is not None:
        code = code.when(~inside(path, root), "E_POLICY_OUTSIDE_ROOT")
    return code.when(denied(path).isNotNull(), "E_POLICY_HARD_DENY")


def size_code(size: Column, most: int = MAX_FILE_BYTES) -> Column:
    return F.when(size > most, "E_POLICY_SIZE")


def is_binary(content: Column) -> Column:
    """A NUL byte, or bytes that are not UTF-8, among the first 8 KB."""
    head = F.substring(content, 1, SNIFF_BYTES)
    return F.when(F.octet_length(head) == 0, F.lit(False)).otherwise((F.instr(F.hex(head), "00") > 0) & F.hex(head).rlike("^(..)*00") | ~F.is_valid_utf8(head.cast("string")))
