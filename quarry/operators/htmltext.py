"""Per-page helper for P1/P2: find section elements and their text.

A small tree builder on the standard-library ``html.parser`` with the tree
rules of the reference's parser setup (``html.parser`` back end):
* no implicit closing: an unclosed ``<p>`` nests what follows;
* an end tag closes the most recent open element of that name and every
  element opened after it; an end tag with no open element is ignored;
* void elements (``br``, ``img``, ...) never hold children;
* strings inside ``script``/``style``/``template``/``rt``/``rp`` are their own
  kinds and are left out of an enclosing element's text, comments too.

Section text: for each child in order, a string child (comments included)
is stripped and kept when not blank; a direct ``section`` child is skipped;
any other element adds its stripped full text (possibly an empty line).
Parts are joined with ``"\\n"``.
"""

from __future__ import annotations

from html.parser import HTMLParser

VOID = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)
STRING_CONTAINERS = frozenset(["script", "style", "template", "rt", "rp"])
TEXT_KINDS = frozenset(["text", "cdata"])


class Node:
    __slots__ = ("name", "attrs", "children", "parent")

    def __init__(self, name, attrs, parent):
        self.name = name
        self.attrs = attrs
        self.children = []
        self.parent = parent


class Text:
    __slots__ = ("value", "kind")

    def __init__(self, value, kind):
        self.value = value
        self.kind = kind


ASCII_SPACES = "\x20\x0a\x09\x0c\x0d"
PRESERVE_SPACE = frozenset(["pre", "textarea"])


class _Builder(HTMLParser):
    """Text between two markup events becomes one string node; a run of
    ASCII white space alone becomes a single newline (or space)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("[document]", {}, None)
        self.stack = [self.root]
        self.containers: list[str] = []
        self.pending: list[str] = []

    def _flush(self):
        if not self.pending:
            return
        data = "".join(self.pending)
        self.pending = []
        if data.strip(ASCII_SPACES) == "" and not any(
            n.name in PRESERVE_SPACE for n in self.stack
        ):
            data = "\n" if "\n" in data else " "
        kind = self.containers[-1] if self.containers else "text"
        self.stack[-1].children.append(Text(data, kind))

    def handle_starttag(self, tag, attrs):
        self._flush()
        d = {}
        for k, v in attrs:
            d[k] = "" if v is None else v
        node = Node(tag, d, self.stack[-1])
        self.stack[-1].children.append(node)
        if tag in VOID:
            return
        self.stack.append(node)
        if tag in STRING_CONTAINERS:
            self.containers.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].name == tag:
                for node in self.stack[i:]:
                    if node.name in STRING_CONTAINERS and self.containers:
                        self.containers.pop()
                del self.stack[i:]
                return

    def handle_data(self, data):
        if data:
            self.pending.append(data)

    def _leaf(self, value, kind):
        self._flush()
        self.stack[-1].children.append(Text(value, kind))

    def handle_comment(self, data):
        self._leaf(data, "comment")

    def handle_decl(self, decl):
        self._leaf(decl, "doctype")

    def unknown_decl(self, data):
        if data.upper().startswith("CDATA["):
            self._leaf(data[6:], "cdata")

    def handle_pi(self, data):
        self._leaf(data, "pi")

    def close(self):
        super().close()
        self._flush()


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def iter_elements(node: Node):
    """Descendant elements in document order."""
    todo = list(reversed(node.children))
    while todo:
        n = todo.pop()
        if isinstance(n, Node):
            yield n
            todo.extend(reversed(n.children))


def find(node: Node, name: str):
    for n in iter_elements(node):
        if n.name == name:
            return n
    return None


def get_text(node: Node) -> str:
    kinds = {node.name} if node.name in STRING_CONTAINERS else TEXT_KINDS
    parts = []
    todo = list(reversed(node.children))
    while todo:
        n = todo.pop()
        if isinstance(n, Text):
            if n.kind in kinds:
                parts.append(n.value)
        else:
            todo.extend(reversed(n.children))
    return "".join(parts)


def section_text(section: Node) -> str:
    """Every direct child but a nested section is one line, stripped; a
    bare string that is blank gives no line, a blank element an empty one."""
    own = (c for c in section.children if isinstance(c, Text) or c.name != "section")
    lines = ((isinstance(c, Text), (c.value if isinstance(c, Text) else get_text(c)).strip()) for c in own)
    return "\n".join(line for bare, line in lines if line or not bare)


def page_sections(html: str, tag: str = "section"):
    """``(status, [(section_pos, href_or_None, has_anchor, text)])`` of one page.

    status: ``ok``, ``no_body`` or ``no_section``. ``href`` is the first
    ``<a>`` below the section (at any depth); ``has_anchor`` tells an ``<a>``
    without ``href`` from no ``<a>`` at all.
    """
    root = parse(html)
    body = find(root, "body")
    if body is None:
        return "no_body", []
    sections = [n for n in iter_elements(body) if n.name == tag]
    if not sections:
        return "no_section", []
    out = []
    for pos, sec in enumerate(sections):
        a = find(sec, "a")
        href = a.attrs.get("href") if a is not None else None
        out.append((pos, href, a is not None, section_text(sec)))
    return "ok", out
