"""Regular expressions in Java's dialect that mean what Python's mean over Unicode."""

from __future__ import annotations

WORD_CHAR = r"[\p{L}\p{N}_]"
WORD = rf"{WORD_CHAR}+"
#: A word or what stands between two.
PIECE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"
#: Unicode white space as Python's \s has it, and its complement.
SPACE = r"(?U:[\s\x1c-\x1f])"
NOT_SPACE = r"(?U:[^\s\x1c-\x1f])"
#: Regions of a text that are not prose, each looked for on its own.
PROTECTED = {
    "fenced": r"(?s)```.*?```",
    "indented": r"(?md)^(?: {4}|\t).+$",
    "inline": r"`[^`\n]+`",
    "url": rf"https?://{NOT_SPACE}+",
}
#: What a text must hold for a region of the kind; looking for it is much cheaper than the pattern.
HINTS = {"fenced": ("```",), "indented": ("    ", "\t"), "inline": ("`",), "url": ("http",)}
#: Words before a full stop that does not end a sentence.
ABBREVIATIONS = ("e.g", "i.e", "etc", "vs", "dr", "mr", "mrs", "ms", "prof", "sr", "jr", "st", "no", "vol", "fig", "dept", "approx", "corp", "inc", "ltd", "est")
_ABBREVIATED = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
#: The end of a sentence and a blank line.  An abbreviation is one only if no letter or full stop is before it.
BOUNDARY = rf"(?:[!?]|\.(?<!(?<![\p{{L}}.])(?iu:{_ABBREVIATED})\.)){SPACE}+(?=[A-Z])"
BLANK_LINE = r"\n[ \t]*\n"


def any_of(words: list[str]) -> str:
    """One pattern for a list of ASCII words in any case, with common beginnings factored out.

    Many ways on are halved by their first character, so that a word of the text is held against some five classes instead of
    all letters in turn.  Of what lies past ASCII only the Kelvin sign has an ASCII letter as its lower case.
    """
    tree: dict = {}
    for w in words:
        node = tree
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = {}

    def one(ch: str) -> str:
        return "[kK\u212a]" if ch in "kK" else ch if ch.isalnum() else "\\" + ch

    def either(ways: list[tuple[str, str]]) -> str:
        if len(ways) <= 3:
            return "|".join(way for _, way in ways)
        left, right = ways[: len(ways) // 2], ways[len(ways) // 2 :]
        first = "".join("kK\u212a" if ch in "kK" else "\\" + ch if not ch.isalnum() else ch for ch, _ in left)
        return f"(?=[{first}])(?:{either(left)})|(?:{either(right)})"

    def pattern(node: dict) -> str:
        ways = [(ch, one(ch) + pattern(sub)) for ch, sub in sorted(node.items()) if ch]
        if not ways:
            return ""
        body = ways[0][1] if len(ways) == 1 and "" not in node else f"(?:{either(ways)})"
        return body + "?" if "" in node else body

    return rf"(?i)(?<!{WORD_CHAR}){pattern(tree) or '(?!)'}(?!{WORD_CHAR})"
