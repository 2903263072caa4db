"""The flags of the line-search front-end: which are known, which take a value, which are acted on."""

from __future__ import annotations

#: Short names of long flags.
SHORT = {
    "A": "after-context", "B": "before-context", "C": "context", "E": "encoding", "F": "fixed-strings", "H": "with-filename", "I": "no-filename", "L": "follow", "M": "max-columns", "N": "no-line-number",
    "P": "pcre2", "S": "smart-case", "T": "type-not", "U": "multiline", "V": "version", "a": "text", "b": "byte-offset", "c": "count", "e": "regexp", "f": "file", "g": "glob", "h": "help", "i": "ignore-case",
    "j": "threads", "l": "files-with-matches", "m": "max-count", "n": "line-number", "o": "only-matching", "p": "pretty", "q": "quiet", "r": "replace", "s": "case-sensitive", "t": "type", "u": "unrestricted",
    "v": "invert-match", "w": "word-regexp", "x": "line-regexp", "z": "search-zip", "0": "null", ".": "hidden", "d": "max-depth",
}
VALUE = frozenset(
    "after-context before-context color colors context context-separator dfa-size-limit encoding engine field-context-separator field-match-separator file generate glob hostname-bin hyperlink-format iglob ignore-file max-columns max-count max-depth max-filesize path-separator pre pre-glob regex-size-limit regexp replace sort sortr threads type type-add type-clear type-not".split()
)
BOOL = frozenset(
    "auto-hybrid-regex binary block-buffered byte-offset case-sensitive column count count-matches crlf debug files files-with-matches files-without-match fixed-strings follow glob-case-insensitive heading help hidden ignore-case ignore-file-case-insensitive include-zero invert-match json line-buffered line-number line-regexp max-columns-preview mmap multiline multiline-dotall no-column no-config no-filename no-heading no-ignore no-ignore-dot no-ignore-exclude no-ignore-files no-ignore-global no-ignore-messages no-ignore-parent no-ignore-vcs no-line-number no-messages no-mmap no-pcre2-unicode no-require-git no-unicode null null-data one-file-system only-matching passthru pcre2 pcre2-version pretty print0 quiet search-zip smart-case stats stop-on-nonmatch text trace trim type-list unrestricted version vimgrep with-filename word-regexp".split()
)
#: Flags that a search acts on or may ignore without a change in what it finds; any other means falling back to the real tool.
ACCEPTED = frozenset(
    "after-context before-context case-sensitive color colors context count files-with-matches fixed-strings glob heading hidden ignore-case json line-number max-count multiline multiline-dotall no-config no-heading no-ignore no-line-number no-messages smart-case type".split()
)
#: Globs of the commoner file types.
TYPES = {
    "c": ("*.c", "*.h"), "cpp": ("*.cpp", "*.cc", "*.hpp", "*.h"), "css": ("*.css",), "go": ("*.go",), "html": ("*.html", "*.htm"), "java": ("*.java",), "js": ("*.js", "*.jsx", "*.mjs"), "json": ("*.json",), "md": ("*.md", "*.markdown"),
    "py": ("*.py", "*.pyi"), "rust": ("*.rs",), "sh": ("*.sh", "*.bash", "*.zsh"), "sql": ("*.sql",), "toml": ("*.toml",), "ts": ("*.ts", "*.tsx"), "txt": ("*.txt",), "xml": ("*.xml",), "yaml": ("*.yaml", "*.yml"),
}


def long_name(flag: str) -> str | None:
    """The long name, without dashes, of a spelling as given; None for an unknown one."""
    name = flag[2:] if flag.startswith("--") else SHORT.get(flag[1:], "") if flag[:1] == "-" else ""
    return name if name in VALUE or name in BOOL else None


def kind(flag: str) -> str | None:
    """value or bool; --flag=x is a value; None for an unknown flag."""
    own, equals, _ = flag.partition("=")
    name = long_name(own)
    return None if name is None else "value" if equals or name in VALUE else "bool"
