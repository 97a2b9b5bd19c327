"""Per-page HTML tree builder (the one piece of per-row Python in the engine).

It turns one HTML string into flat, columnar node records: one record per
element, in document (pre-)order, plus one ``#document`` record (node 0) that
carries the page's concatenated text.  Everything after this step -- selector
matching, value extraction, containers, joins -- is DataFrame work over those
records.

Tree rules for broken markup (what a lenient HTML parser does):

* void elements never open a scope;
* a ``p`` is closed by the start of a block element (when a ``p`` is open in
  button scope); ``li``, ``dt``/``dd``, ``tr``, ``td``/``th``, ``option`` close
  an open element of their own kind;
* an end tag without a matching open element is ignored;
* closing an element closes everything still open inside it;
* ``script`` / ``style`` are raw text and are left out of the page text;
* character references are decoded.
"""

from __future__ import annotations

import re
from html import unescape

# HTML element categories (from the HTML standard).
VOID_TAGS = frozenset(
    "area base br col embed hr img input keygen link meta param source track wbr command".split()
)
P_CLOSING_TAGS = frozenset(
    "address article aside blockquote details dialog div dl dd dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul".split()
)
BUTTON_SCOPE = frozenset("applet caption html table td th marquee object template button".split())
RAW_TEXT_TAGS = frozenset({"script", "style"})
# Elements nest this deep at most, as in browsers; deeper ones become siblings.
MAX_DEPTH = 512
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})

_SPACE = re.compile(r"\s+")

# Output field order of ``parse_page`` rows.
NODE_FIELDS = (
    "node_id", "parent_id", "depth", "ordinal", "n_sib", "type_ordinal", "type_count",
    "tag", "elem_id", "classes", "attrs", "own_text", "text_start", "text_end",
    "html_start", "html_end", "path", "doc_text", "short_text",
)
# Nodes with full text up to this length carry it; longer ones are slices of the page text.
SHORT_TEXT = 256


# One scan of the page: comments, declarations, processing instructions, end
# tags and start tags (quoted attribute values may contain ">").  Anything
# else -- including a "<" that starts no tag -- is text.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<![^>]*>?"
    r"|<\?[^>]*>?"
    r"|</([a-zA-Z][^\s/>]*)[^>]*>?"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S)
_ATTR = re.compile(r"""((?<=[\s'"/])|^)([^\s/>"'=][^\s/>"'=]*)(?:\s*=+\s*('[^']*'|"[^"]*"|(?!['"])[^>\s]*))?""")


class _TreeBuilder:
    def __init__(self, html: str):
        self.src = html
        # node 0 is the document
        self.tag = ["#document"]
        self.parent = [-1]
        self.attrs = [{}]
        self.own = [[]]
        self.text_start = [0]
        self.text_end = [0]
        self.html_start = [0]
        self.html_end = [len(html)]
        self.path = [[]]
        self.ordinal = [1]
        self.type_ordinal = [1]
        self.child_n = [0]
        self.child_types = [{}]
        self.stack = [0]
        self.text_parts: list[str] = []
        self.text_len = 0

    # -- scanning ------------------------------------------------------------
    def feed(self, html: str) -> None:
        pos, n = 0, len(html)
        search = _TOKEN.search
        while pos < n:
            m = search(html, pos)
            if m is None:
                self.handle_data(unescape(html[pos:]))
                break
            if m.start() > pos:
                self.handle_data(unescape(html[pos:m.start()]))
            end_name, start_name = m.group(1), m.group(2)
            pos = m.end()
            if start_name is not None:
                tag = start_name.lower()
                raw_attrs = m.group(3)
                self_closing = raw_attrs.rstrip().endswith("/")
                attrs = [(a.lower(), _attr_value(v)) for _, a, v in _ATTR.findall(raw_attrs)
                         if a and a != "/"]
                self._open(tag, attrs, m.start(), pos, void=self_closing or tag in VOID_TAGS)
                if tag in RAW_TEXT_TAGS and not self_closing:
                    close = re.compile(r"</" + tag + r"\s*>?", re.I).search(html, pos)
                    stop = close.start() if close else n
                    if stop > pos:
                        self.handle_data(html[pos:stop])
                    if close is None:
                        break
                    pos = close.end()
                    self.handle_endtag(tag, close.start(), close.end())
            elif end_name is not None:
                self.handle_endtag(end_name.lower(), m.start(), pos)

    def _close_top(self, end: int) -> None:
        i = self.stack.pop()
        self.html_end[i] = end
        self.text_end[i] = self.text_len

    def _pop_through(self, pos: int, end: int) -> None:
        while len(self.stack) > pos:
            self._close_top(end)

    def _find_open(self, names, boundary) -> int:
        for pos in range(len(self.stack) - 1, 0, -1):
            t = self.tag[self.stack[pos]]
            if t in names:
                return pos
            if t in boundary:
                return -1
        return -1

    # -- handlers ------------------------------------------------------------
    def _open(self, tag, attrs, start, end, void):
        if tag in ("html", "head", "body") and any(self.tag[i] == tag for i in self.stack):
            return
        if tag in P_CLOSING_TAGS:
            pos = self._find_open(("p",), BUTTON_SCOPE)
            if pos > 0:
                self._pop_through(pos, start)
        if tag == "li":
            pos = self._find_open(("li",), BUTTON_SCOPE | {"ul", "ol"})
            if pos > 0:
                self._pop_through(pos, start)
        elif tag in ("dt", "dd"):
            pos = self._find_open(("dt", "dd"), BUTTON_SCOPE | {"dl"})
            if pos > 0:
                self._pop_through(pos, start)
        elif tag == "tr":
            pos = self._find_open(("tr",), {"table", "thead", "tbody", "tfoot"})
            if pos > 0:
                self._pop_through(pos, start)
        elif tag in ("td", "th"):
            pos = self._find_open(("td", "th"), {"tr", "table"})
            if pos > 0:
                self._pop_through(pos, start)
        elif tag in ("option", "optgroup"):
            names = ("option",) if tag == "option" else ("option", "optgroup")
            pos = self._find_open(names, {"select", "datalist"})
            if pos > 0:
                self._pop_through(pos, start)
        elif tag in HEADINGS and self.tag[self.stack[-1]] in HEADINGS:
            self._pop_through(len(self.stack) - 1, start)
        elif tag == "a":
            pos = self._find_open(("a",), BUTTON_SCOPE)
            if pos > 0:
                self._pop_through(pos, start)

        if len(self.stack) > MAX_DEPTH:
            self._pop_through(MAX_DEPTH, start)
        parent = self.stack[-1]
        node = len(self.tag)
        amap = {}
        for k, v in attrs:
            if k not in amap:
                amap[k] = "" if v is None else v
        self.child_n[parent] += 1
        types = self.child_types[parent]
        types[tag] = types.get(tag, 0) + 1
        self.tag.append(tag)
        self.parent.append(parent)
        self.attrs.append(amap)
        self.own.append([])
        self.text_start.append(self.text_len)
        self.text_end.append(self.text_len)
        self.html_start.append(start)
        self.html_end.append(end)
        self.path.append(self.path[parent] + [parent] if parent else [])
        self.ordinal.append(self.child_n[parent])
        self.type_ordinal.append(types[tag])
        self.child_n.append(0)
        self.child_types.append({})
        if not void:
            self.stack.append(node)

    def handle_endtag(self, tag, start, end):
        pos = self._find_open((tag,), ())
        if pos > 0:
            self._pop_through(pos, end)

    def handle_data(self, data):
        top = self.stack[-1]
        self.own[top].append(data)
        if self.tag[top] in RAW_TEXT_TAGS:
            return
        self.text_parts.append(data)
        self.text_len += len(data)

    def finish(self):
        end = len(self.src)
        while len(self.stack) > 1:
            self._close_top(end)
        self.text_end[0] = self.text_len


def _attr_value(v: str):
    if v[:1] in ("'", '"') and v[-1:] == v[:1] and len(v) >= 2:
        v = v[1:-1]
    return unescape(v) if v else ""


def parse_page(html: str | None):
    """Return the node records of one page as a dict of equal-length lists."""
    b = _TreeBuilder(html or "")
    b.feed(html or "")
    b.finish()
    n = len(b.tag)
    text = "".join(b.text_parts)
    n_sib = [b.child_n[b.parent[i]] if i else 1 for i in range(n)]
    type_count = [b.child_types[b.parent[i]][b.tag[i]] if i else 1 for i in range(n)]
    classes = [_SPACE.split(a.get("class", "").strip()) if a.get("class", "").strip() else [] for a in b.attrs]
    return {
        "node_id": list(range(n)),
        "parent_id": [p if p >= 0 else None for p in b.parent],
        "depth": [len(p) for p in b.path],
        "ordinal": b.ordinal,
        "n_sib": n_sib,
        "type_ordinal": b.type_ordinal,
        "type_count": type_count,
        "tag": b.tag,
        "elem_id": [a.get("id") for a in b.attrs],
        "classes": classes,
        "attrs": [list(a.items()) for a in b.attrs],
        "own_text": ["".join(o) for o in b.own],
        "text_start": b.text_start,
        "text_end": b.text_end,
        "html_start": b.html_start,
        "html_end": b.html_end,
        "path": b.path,
        "doc_text": [text] + [None] * (n - 1),
        "short_text": [text[s:e] if e - s <= SHORT_TEXT else None for s, e in zip(b.text_start, b.text_end)],
    }
