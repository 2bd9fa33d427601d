"""Small element tree for the few page facts that need nesting.

Only used inside Arrow batches (see `pages.py`): one page in, a handful of strings out.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr",
}
# Elements whose text never shows, and elements dropped before conversion.
SILENT = {"script", "style", "template"}
DROPPED = {"script", "style", "noscript", "svg", "form", "button", "iframe"}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "number", "numbered")

    def __init__(self, tag, attrs=None, parent=None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent
        self.number = self.numbered = 0

    def walk(self):
        """Element nodes below this one in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def strings(self, raw=False):
        stack = list(reversed(self.children))
        while stack:
            item = stack.pop()
            if isinstance(item, Node):
                if item.tag not in SILENT:
                    stack.extend(reversed(item.children))
            elif raw or item.strip():
                yield item if raw else item.strip()

    def text(self, sep=" "):
        return sep.join(self.strings())

    def remove(self):
        self.parent.children.remove(self)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")

    def handle_starttag(self, tag, attrs):
        values = {}
        for key, value in attrs:
            values.setdefault(key, value or "")
        node = Node(tag, values, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


_PART = re.compile(r"([#.]?)([\w-]+)|\[([\w-]+)(?:([*]?=)'?\"?([^\]'\"]*)'?\"?)?\]")


@lru_cache(maxsize=512)
def _paths(selectors: str):
    """Selector list as paths of compounds, each a tuple of (kind, word, operator, value) tests."""
    out = []
    for selector in re.split(r",\s*(?![^\[]*\])", selectors):
        path = []
        for simple in selector.split():
            path.append(
                tuple(
                    ("[", attr, op, value) if attr else (kind, word, "", "")
                    for kind, word, attr, op, value in _PART.findall(simple)
                )
            )
        out.append(path)
    return out


def _fits(node: Node, tests) -> bool:
    for kind, word, op, value in tests:
        if kind == "":
            good = node.tag == word
        elif kind == ".":
            good = "class" in node.attrs and word in node.attrs["class"].split()
        elif kind == "#":
            good = node.attrs.get("id") == word
        else:
            have = node.attrs.get(word)
            good = have is not None and (not op or (value in have if op == "*=" else have == value))
        if not good:
            return False
    return True


def _matches(node: Node, path) -> bool:
    if not _fits(node, path[-1]):
        return False
    left, up = len(path) - 1, node.parent
    while left and up is not None:
        if _fits(up, path[left - 1]):
            left -= 1
        up = up.parent
    return not left


def select(root: Node, selectors: str):
    """Nodes that match any of the comma-separated descendant selectors, in page order."""
    paths = _paths(selectors)
    return [n for n in root.walk() if any(_matches(n, p) for p in paths)]


def first(root: Node, selectors: str):
    paths = _paths(selectors)
    return next((n for n in root.walk() if any(_matches(n, p) for p in paths)), None)


def ranked(root: Node, selectors):
    """(rank of the first matching selector, node) in page order, from one walk."""
    lists = [_paths(s) for s in selectors]
    for node in root.walk():
        for rank, paths in enumerate(lists):
            if any(_matches(node, p) for p in paths):
                yield rank, node
                break


# A code listing put in by a page reader: attrs lang and code, shown as they are.
FENCE = "#fence"
_WRAP = {"b": "**", "strong": "**", "em": "*", "i": "*", "del": "~~", "s": "~~"}


def _inline_text(text: str, pre: bool) -> str:
    if pre:
        return text
    text = re.sub(r"[\t \r\n]*[\r\n][\t \r\n]*", "\n", text)
    text = re.sub(r"[\t ]+", " ", text)
    return re.sub(r"([*_])", r"\\\1", text)


def _render(node: Node, pre: bool = False) -> str:
    """Markdown of what is inside a node; an explicit stack, so depth is no limit."""
    open_nodes = [(node, pre, iter(node.children), [])]
    while True:
        at, inside_pre, rest, parts = open_nodes[-1]
        item = 0
        for child in rest:
            if not isinstance(child, Node):
                parts.append(_inline_text(child, inside_pre))
                continue
            if at.tag == "ol" and child.tag == "li":
                item = at.numbered = at.numbered + 1
            done = _leaf(child)
            if done is None:
                child.number = item if at.tag == "ol" else 0
                open_nodes.append((child, inside_pre or child.tag in ("pre", "code"), iter(child.children), []))
                break
            parts.append(done)
        else:
            open_nodes.pop()
            text = "".join(parts)
            if not open_nodes:
                return text
            parent = open_nodes[-1]
            parent[3].append(_dress(at, text, parent[1]))


def _cells(row: Node):
    return [_render(c).strip().replace("\n", " ") for c in row.children
            if isinstance(c, Node) and c.tag in ("td", "th")]


def _table(node: Node) -> str:
    rows = [_cells(r) for r in node.walk() if r.tag == "tr"]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    lines = ["| " + " | ".join(r) + " |" for r in rows]
    lines.insert(1, "| " + " | ".join("---" for _ in rows[0]) + " |")
    return "\n\n" + "\n".join(lines) + "\n\n"


def _leaf(node: Node) -> str | None:
    """Markdown of a node whose inside is not rendered by the general rule, else None."""
    tag = node.tag
    if tag in DROPPED or tag in SILENT:
        return ""
    if tag == FENCE:
        return f"\n\n\n```{node.attrs['lang']}\n{node.attrs['code']}\n```\n\n\n"
    if tag == "br":
        return "\n"
    if tag == "hr":
        return "\n\n---\n\n"
    if tag == "img":
        return f"![{node.attrs.get('alt', '')}]({node.attrs.get('src', '')})"
    if tag == "table":
        return _table(node)
    return None


def _dress(node: Node, inner: str, pre: bool) -> str:
    """A node's own marks around the Markdown of its inside."""
    tag, bare = node.tag, inner.strip()
    if re.fullmatch(r"h[1-6]", tag):
        title = re.sub(r"\s+", " ", bare)
        return f"\n\n{'#' * int(tag[1])} {title}\n\n" if title else ""
    if tag in _WRAP and not pre:
        mark = _WRAP[tag]
        lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()):]
        return f"{lead and ' '}{mark}{bare}{mark}{tail and ' '}" if bare else ""
    if tag == "a" and not pre:
        href = node.attrs.get("href", "")
        lead, tail = inner[:1].isspace(), inner[-1:].isspace()
        link = f"[{bare}]({href})" if href and bare else bare
        return f"{' ' if lead else ''}{link}{' ' if tail else ''}" if bare else ""
    if tag == "code" and not pre:
        return f"`{bare}`" if bare else ""
    if tag == "pre":
        return f"\n\n```\n{inner}\n```\n\n" if inner else ""
    if tag == "blockquote":
        return "\n\n" + "\n".join("> " + l if l else ">" for l in bare.split("\n")) + "\n\n" if bare else ""
    if tag == "li":
        number = f"{node.number}. " if node.number else ""
        body = bare.replace("\n", "\n  ")
        return f"{number or '- '}{body}\n"
    if tag in ("ul", "ol"):
        nested = node.parent is not None and node.parent.tag == "li"
        return ("\n" if nested else "\n\n") + inner.strip() + ("\n" if nested else "\n\n")
    if tag in ("p", "div", "article", "section", "main", "figure", "figcaption", "dl", "dd", "dt"):
        return f"\n\n{bare}\n\n" if bare else ""
    return inner


def to_markdown(node: Node) -> str:
    """Readable Markdown of a fragment: ATX headings, `-` bullets, blank lines collapsed."""
    if node.tag == "#root":
        text = _render(node)
    elif (text := _leaf(node)) is None:
        text = _dress(node, _render(node, node.tag in ("pre", "code")), False)
    text = re.sub(r"\n[ \t]+\n", "\n\n", text)
    # Around a fence one blank line more is kept.
    return re.sub(r"\n{3,}", lambda m: "\n\n\n" if _beside_fence(text, m) else "\n\n", text).strip()


def _beside_fence(text: str, gap: re.Match) -> bool:
    return len(gap[0]) > 2 and (text.startswith("```", gap.end()) or text.endswith("\n```", 0, gap.start()))
