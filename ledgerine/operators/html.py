"""HTML as a relation: every document becomes nodes in pre-order with subtree intervals; all else is expressions over them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import escape, unescape
from html.parser import HTMLParser
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formatting import trimmed
from ..schemas import NODES

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("title meta link script style base noscript template".split())
RAW = frozenset("script style".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split())
INLINE = frozenset("span em strong a br".split())
SCOPE = frozenset("html table td th caption object applet marquee template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that an inline end tag does not cross.
SPECIAL = CLOSES_P | HEAD | VOID | frozenset("applet body button caption colgroup frameset head html iframe marquee noembed noframes object select tbody td textarea tfoot th thead tr xmp".split())
#: Content that is not of a table moves before it from these.
PARTS = frozenset("table tbody thead tfoot tr".split())
#: Parts of tables by how deep they stand; those of ``MARKED`` hold content.
LEVEL = {"table": 0, "caption": 1, "colgroup": 1, "tbody": 1, "thead": 1, "tfoot": 1, "tr": 2, "col": 2, "td": 3, "th": 3}
MARKED = frozenset("td th caption".split())
TABLES = frozenset({"table"})
TABLE_LEVELS = PARTS | {"colgroup"}
P_SCOPE = SCOPE | {"button"}
LI_SCOPE = SCOPE | {"ul", "ol"}
#: A start tag closes the innermost open element of its set, if no element of the second lies within.
CLOSING = {k: (v, SPECIAL - v - {"address", "div", "p"}) for k, v in {"li": frozenset({"li"}), "dd": frozenset({"dd", "dt"}), "dt": frozenset({"dd", "dt"}), "option": frozenset({"option"})}.items()}
#: Tagged elements that are read as XML.
DECODED = frozenset("ix:nonfraction ix:nonnumeric ix:fraction xbrli:context xbrli:unit".split())
#: Elements that may stand in a select, and those that end it.
IN_SELECT, ENDS_SELECT = frozenset("option optgroup script template hr".split()), frozenset("input keygen textarea".split())
# Public identifiers of doctypes, as they begin, that put a document into quirks mode (HTML standard), in lower case.
QUIRKY = (
    "+//silmaril//dtd html pro v0r11 19970101//", "-//as//dtd html 3.0 aswedit + extensions//", "-//advasoft ltd//dtd html 3.0 aswedit + extensions//",
    "-//ietf//dtd html 2.0 level 1//", "-//ietf//dtd html 2.0 level 2//", "-//ietf//dtd html 2.0 strict level 1//", "-//ietf//dtd html 2.0 strict level 2//", "-//ietf//dtd html 2.0 strict//", "-//ietf//dtd html 2.0//",
    "-//ietf//dtd html 2.1e//", "-//ietf//dtd html 3.0//", "-//ietf//dtd html 3.2 final//", "-//ietf//dtd html 3.2//", "-//ietf//dtd html 3//", "-//ietf//dtd html level 0//", "-//ietf//dtd html level 1//",
    "-//ietf//dtd html level 2//", "-//ietf//dtd html level 3//", "-//ietf//dtd html strict level 0//", "-//ietf//dtd html strict level 1//", "-//ietf//dtd html strict level 2//", "-//ietf//dtd html strict level 3//",
    "-//ietf//dtd html strict//", "-//ietf//dtd html//", "-//metrius//dtd metrius presentational//", "-//microsoft//dtd internet explorer 2.0 html strict//", "-//microsoft//dtd internet explorer 2.0 html//",
    "-//microsoft//dtd internet explorer 2.0 tables//", "-//microsoft//dtd internet explorer 3.0 html strict//", "-//microsoft//dtd internet explorer 3.0 html//", "-//microsoft//dtd internet explorer 3.0 tables//",
    "-//netscape comm. corp.//dtd html//", "-//netscape comm. corp.//dtd strict html//", "-//o'reilly and associates//dtd html 2.0//", "-//o'reilly and associates//dtd html extended 1.0//",
    "-//o'reilly and associates//dtd html extended relaxed 1.0//", "-//sq//dtd html 2.0 hotmetal + extensions//", "-//softquad software//dtd hotmetal pro 6.0::19990601::extensions to html 4.0//",
    "-//softquad//dtd hotmetal pro 4.0::19971010::extensions to html 4.0//", "-//spyglass//dtd html 2.0 extended//", "-//sun microsystems corp.//dtd hotjava html//", "-//sun microsystems corp.//dtd hotjava strict html//",
    "-//w3c//dtd html 3 1995-03-24//", "-//w3c//dtd html 3.2 draft//", "-//w3c//dtd html 3.2 final//", "-//w3c//dtd html 3.2//", "-//w3c//dtd html 3.2s draft//", "-//w3c//dtd html 4.0 frameset//",
    "-//w3c//dtd html 4.0 transitional//", "-//w3c//dtd html experimental 19960712//", "-//w3c//dtd html experimental 970421//", "-//w3c//dtd w3 html//", "-//w3o//dtd w3 html 3.0//", "-//webtechs//dtd mozilla html 2.0//",
    "-//webtechs//dtd mozilla html//",
)
QUIRKY_WHOLE = ("-//w3o//dtd w3 html strict 3.0//en//", "-/w3c/dtd html 4.0 transitional/en", "html")
#: Those that do so only without a system identifier.
QUIRKY_ALONE = ("-//w3c//dtd html 4.01 frameset//", "-//w3c//dtd html 4.01 transitional//")
DOCTYPE = re.compile(r"""doctype\s+([^\s>]+)(?:\s+(?:public\s*(?:"([^"]*)"|'([^']*)')(?:\s*(?:"([^"]*)"|'([^']*)'))?|system\s*(?:"([^"]*)"|'([^']*)')))?""", re.IGNORECASE)
#: What XML does not take: characters, and names (one colon at most).
NO_CHARACTER = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")
NAME = re.compile(r"[^\W\d][\w.\-\u00b7]*(:[\w.\-\u00b7]+)?|:[\w.\-\u00b7]*")


class Node:
    __slots__ = ("attrs", "children", "data", "kind", "parent", "tag")

    def __init__(self, kind: str, tag: str | None = None, attrs: dict | None = None, data: str | None = None):
        self.kind, self.tag, self.attrs, self.data, self.children, self.parent = kind, tag, attrs, data, [], None

    def add(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def place_of(self, child: Node) -> int:
        """Looked for from the end, where it nearly always is."""
        return next(i for i in range(len(self.children) - 1, -1, -1) if self.children[i] is child)

    def leave(self) -> None:
        if self.parent is not None:
            del self.parent.children[self.parent.place_of(self)]


def is_quirky(decl: str) -> bool:
    """Whether a doctype puts its document into quirks mode."""
    found = DOCTYPE.match(decl)
    if found is None or found[1].lower() != "html":
        return True
    public = next((x for x in found.group(2, 3) if x is not None), None)
    system = next((x for x in found.group(4, 5, 6, 7) if x is not None), None)
    if system is not None and system.lower() == "http://www.ibm.com/data/dtd/v11/ibmxhtml1-transitional.dtd":
        return True
    return public is not None and (public.lower() in QUIRKY_WHOLE or public.lower().startswith(QUIRKY) or system is None and public.lower().startswith(QUIRKY_ALONE))


class Builder(HTMLParser):
    """Tree construction by the rules of the HTML standard: implied html, head, body and table parts, elements that end others, void and
    raw-text elements, formatting elements that stay open across blocks (adoption agency), and content misplaced in a table, which moves
    before it (foster parenting). A slash at the end of an unknown tag does not close it. A document without a doctype named html is read
    in quirks mode, and so is one with a public identifier of old; there a table does not end a paragraph. In a select only options and their groups
    are elements. Frames are not special."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("document")
        self.html = self.head = self.body = None
        self.stack: list[Node] = []
        self.active: list[Node | None] = []  # None: a cell or caption began
        self.quirks = True
        self.selects = 0  # how many there are so far

    def _html(self, attrs: dict | None = None) -> None:
        if self.html is None:
            self.html = self.root.add(Node("element", "html", attrs or {}))
            self.stack = [self.html]

    def _head(self, attrs: dict | None = None) -> None:
        self._html()
        if self.head is None:
            self.head = self.html.add(Node("element", "head", attrs or {}))

    def _body(self, attrs: dict | None = None) -> None:
        self._head()
        if self.body is None:
            self.body = self.html.add(Node("element", "body", attrs or {}))
            self.stack = [self.html, self.body]

    def _put(self, node: Node, at: Node | None = None) -> Node:
        """Adds to ``at`` (the current node); where that is a part of a table, before the table. Texts in a row are one node."""
        at = at or self.stack[-1]
        before = len(at.children)
        if at.tag in PARTS:
            table = next(x for x in reversed(self.stack) if x.tag == "table")
            at = table.parent
            before = at.place_of(table)
        if node.kind == "text" and before and at.children[before - 1].kind == "text":
            at.children[before - 1].data += node.data
            return at.children[before - 1]
        node.parent = at
        at.children.insert(before, node)
        return node

    def _open(self, tag: str, attrs: dict) -> Node:
        """A part of a table, at its own place."""
        node = self.stack[-1].add(Node("element", tag, attrs))
        self.stack.append(node)
        return node

    def _cut(self, at: int) -> None:
        """Closes all elements from a place of the stack on; formatting does not outlive its cell."""
        for node in self.stack[at:]:
            if node.tag in MARKED and None in self.active:
                while self.active.pop() is not None:
                    pass
        del self.stack[at:]

    def _found(self, tags: set | frozenset, stops: set | frozenset) -> int:
        """Place of the innermost open element of ``tags`` within the innermost of ``stops``, else 0."""
        for i in range(len(self.stack) - 1, 1, -1):
            if self.stack[i].tag in tags:
                return i
            if self.stack[i].tag in stops:
                return 0
        return 0

    def _close(self, tags: set | frozenset, stops: set | frozenset) -> bool:
        at = self._found(tags, stops)
        if at:
            self._cut(at)
        return at > 0

    def _formatting(self) -> list[Node]:
        """Active formatting elements of the current cell, the last one first."""
        return list(takewhile(lambda x: x is not None, reversed(self.active)))

    def _reopen(self) -> None:
        closed = list(takewhile(lambda x: x not in self.stack, self._formatting()))
        for i in range(len(self.active) - len(closed), len(self.active)):
            node = self._put(Node("element", self.active[i].tag, dict(self.active[i].attrs)))
            self.stack.append(node)
            self.active[i] = node

    def _adopt(self, tag: str) -> None:
        """The end of a formatting element: blocks opened inside it leave it, and what is in them is formatted anew."""
        if self.stack[-1].tag == tag and self.stack[-1] not in self.active:
            return self._cut(len(self.stack) - 1)
        for _ in range(8):
            own = next((x for x in self._formatting() if x.tag == tag), None)
            if own is None:
                return self._end_other(tag)
            if own not in self.stack:
                return self.active.remove(own)
            at = self.stack.index(own)
            if any(x.tag in SCOPE for x in self.stack[at + 1 :]):
                return None
            block = next((x for x in self.stack[at + 1 :] if x.tag in SPECIAL), None)
            if block is None:
                self.active.remove(own)
                return self._cut(at)
            mark, last = self.active.index(own), block
            for n, node in enumerate(reversed(self.stack[at + 1 : self.stack.index(block)]), 1):
                if n > 3 and node in self.active:
                    mark -= self.active.index(node) < mark
                    self.active.remove(node)
                if node not in self.active:
                    self.stack.remove(node)
                    continue
                again = Node("element", node.tag, dict(node.attrs))
                place = self.active.index(node)
                self.active[place] = self.stack[self.stack.index(node)] = again
                if last is block:
                    mark = place + 1
                last.leave()  # a block; what is made anew has no place yet
                again.add(last)
                last = again
            last.leave()
            self._put(last, self.stack[at - 1])
            again = Node("element", tag, dict(own.attrs))
            inner, block.children = block.children, []
            for child in inner:
                again.add(child)
            block.add(again)
            mark -= self.active.index(own) < mark
            self.active.remove(own)
            self.active.insert(mark, again)
            self.stack.remove(own)
            self.stack.insert(self.stack.index(block) + 1, again)
        return None

    def _table_part(self, tag: str, attrs: dict) -> None:
        """A start tag of a part of a table ends what is open in its place and implies what is missing; without a table it is ignored."""
        self._close({"td", "th", "caption"}, {"table"})
        at = self._found(TABLE_LEVELS, frozenset())
        if not at:
            return
        if self.stack[at].tag == "colgroup" and tag != "col":
            at -= 1
        level = {"td": 3, "th": 3, "tr": 2, "col": 2}.get(tag, 1)
        while self.stack[at].tag != "table" and LEVEL[self.stack[at].tag] >= level:
            at -= 1
        self._cut(at + 1)
        for implied in {"td": ("tbody", "tr"), "th": ("tbody", "tr"), "tr": ("tbody",), "col": ("colgroup",)}.get(tag, ()):
            if LEVEL[self.stack[-1].tag] < LEVEL[implied]:
                self._open(implied, {})
        node = self._open(tag, attrs)
        if tag == "col":
            self.stack.pop()
        elif tag in MARKED:
            self.active.append(None)

    def _select(self) -> int:
        """Place of the open select, else 0."""
        return self._found({"select"}, {"template"}) if self.selects else 0

    def _stays_in_select(self, at: int, tag: str) -> bool:
        """Whether a start tag within a select is to be taken. What cannot stand in it is passed over; some tags end the select first."""
        if tag in LEVEL or tag in ENDS_SELECT:
            self._cut(at)
            return True
        if tag == "select":
            self._cut(at)
            return False
        if tag in ("option", "optgroup", "hr") and self.stack[-1].tag == "option":
            self.stack.pop()
        if tag in ("optgroup", "hr") and self.stack[-1].tag == "optgroup":
            self.stack.pop()
        return tag in IN_SELECT

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given: dict[str, str] = {}
        for k, v in attrs:
            given.setdefault(k, v or "")
        if tag in ("html", "head", "body"):
            first = getattr(self, tag) is None
            getattr(self, f"_{tag}")(given)
            node = getattr(self, tag)
            if not first and tag != "head":
                node.attrs = given | node.attrs
            return
        if self.body is None and tag in HEAD:
            self._head()
            node = self.head.add(Node("element", tag, given))
            if tag not in VOID:
                self.stack = [self.html, self.head, node]
            return
        self._body()
        if (at := self._select()) and not self._stays_in_select(at, tag):
            return
        if tag in LEVEL and tag != "table":
            self._table_part(tag, given)
            return
        if self.stack[-1].tag == "colgroup":
            self.stack.pop()
        here = self.stack[-1].tag in PARTS
        if tag == "table" and self._found(PARTS, MARKED):
            self._close({"table"}, frozenset())
            here = False
        if tag in CLOSES_P and not (tag == "table" and self.quirks):
            self._close({"p"}, P_SCOPE)
        if tag in CLOSING:
            self._close(*CLOSING[tag])
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.stack.pop()
        if tag in ("a", "nobr"):
            for node in [x for x in self._formatting() if x.tag == tag]:
                self._adopt(tag)
                if node in self.active:
                    self.active.remove(node)
                if node in self.stack:
                    self.stack.remove(node)
        if tag not in CLOSES_P and tag not in HEAD:
            self._reopen()
        node = Node("element", tag, given)
        node = self.stack[-1].add(node) if here and (tag in RAW or tag == "template") else self._put(node)
        if tag not in VOID:
            self.stack.append(node)
            self.selects += tag == "select"
            if tag in FORMATTING:
                same = [x for x in self._formatting() if x.tag == tag and x.attrs == given]
                if len(same) > 2:
                    self.active.remove(same[-1])
                self.active.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in RAW and self.stack and self.stack[-1].tag == tag:
            self.handle_endtag(tag)

    def _end_other(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 1, -1):
            if self.stack[i].tag == tag:
                return self._cut(i)
            if self.stack[i].tag in SPECIAL:
                return None
        return None

    def _end_in_select(self, at: int, tag: str) -> None:
        if tag == "select":
            self._cut(at)
        elif tag == "optgroup" and self.stack[-1].tag == "option" and self.stack[-2].tag == "optgroup":
            del self.stack[-2:]
        elif tag in IN_SELECT and self.stack[-1].tag == tag:
            self.stack.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            return self.handle_starttag("br", [])
        if tag in ("html", "body", "head"):
            return None
        if self.body is None and len(self.stack) == 3 and self.stack[2].tag == tag:
            self.stack = [self.html]
            return None
        if self.body is None:
            return None
        if at := self._select():
            if tag in LEVEL:
                self._cut(at)
            else:
                return self._end_in_select(at, tag)
        if tag in LEVEL:
            self._close({tag}, {"table"})
        elif tag in FORMATTING:
            self._adopt(tag)
        elif tag in HEADINGS:
            self._close(HEADINGS, SCOPE)
        elif tag == "p":
            if not self._close({"p"}, P_SCOPE):
                self._put(Node("element", "p", {}))
        elif tag == "li":
            self._close({"li"}, LI_SCOPE)
        elif tag in CLOSES_P or tag == "button":
            self._close({tag}, SCOPE - {tag})
        else:
            self._end_other(tag)
        return None

    def handle_data(self, data: str) -> None:
        blank = not data.strip(" \t\n\r\f")
        if self.body is None:
            if self.stack and len(self.stack) == 3:
                self._put(Node("text", data=data))
                return
            if blank:
                return
            self._body()
            data = data.lstrip(" \t\n\r\f")
        if self.stack[-1].tag == "colgroup" and not blank:
            self.stack.pop()
        if self.stack[-1].tag in PARTS and blank:
            last = self.stack[-1].children[-1:]
            if last and last[0].kind == "text":
                last[0].data += data
            else:
                self.stack[-1].add(Node("text", data=data))
            return
        if self.stack[-1].tag not in RAW and not self._select():
            self._reopen()
        self._put(Node("text", data=data))

    def _note(self, node: Node) -> None:
        (self.stack[-1] if self.stack else self.root).add(node)

    def handle_comment(self, data: str) -> None:
        self._note(Node("comment", data=data))

    def handle_decl(self, decl: str) -> None:
        if self.html is None:
            self.root.add(Node("doctype", data=decl))
            self.quirks = is_quirky(decl)

    def handle_pi(self, data: str) -> None:
        self._note(Node("comment", data=f"?{data}"))

    def unknown_decl(self, data: str) -> None:
        self._note(Node("comment", data=f"[{data}]"))


def tree(source: str) -> Node:
    builder = Builder()
    builder.feed(source)
    builder.close()
    builder._body()
    return builder.root


#: Tags, comments and elements of raw text; what lies between is text.
PIECES = re.compile(r"(<(?:!--.*?--|script\b[^<>]*>.*?</script|style\b[^<>]*>.*?</style|[^<>]*)>)", re.IGNORECASE | re.DOTALL)
#: An id of a plain element: it differs from document to document and changes no tree.
ID = re.compile(r"""(<(?!(?:%s|html|body)[\s/>])[a-z0-9]+ id=")([^"<>&]+)("(?:[^"'<>]|"[^"<>]*"|'[^'<>]*')*>)""" % "|".join(sorted(FORMATTING)), re.IGNORECASE)
#: A tag with a quote in it ends where its values have ended.
WHOLE = re.compile(r"""<!--.*|<[^"'<>]*(?:"[^"<>]*"[^"'<>]*|'[^'<>]*'[^"'<>]*)*>(?:.*</(?:script|style)>)?""", re.DOTALL | re.IGNORECASE)
BLANK = " \t\n\r\f"
#: Characters that stand for texts while a layout is parsed; documents that hold one of them are parsed by themselves.
FIRST_SLOT = 0xF0000
SLOT = re.compile("[\U000f0000-\U000ffffd]")
#: Layouts that a task keeps, the longest document that is looked up, and slots of a document.
LAYOUTS, LONGEST, SLOTS = 256, 65_536, 4096


class Layout:
    """What of a node table does not depend on texts. Documents made from one template share it; of any other document it is used once."""

    def __init__(self, root: Node):
        order, depth, number, stack = [], {id(root): 0}, {}, [root]
        while stack:  # without recursion, so nesting may be of any depth
            node = stack.pop()
            number[id(node)] = len(order)
            order.append(node)
            for child in reversed(node.children):
                depth[id(child)] = depth[id(node)] + 1
                stack.append(child)
        n = len(order)
        own = [[number[id(c)] for c in x.children] for x in order]
        parent = [number[id(x.parent)] if x.parent is not None else None for x in order]
        leaf = [not any(c.kind == "element" for c in x.children) for x in order]
        table = [x.kind == "element" and x.tag == "table" for x in order]
        inside, end = [False] * n, list(range(n))
        for i in range(n):
            inside[i] = table[i] or parent[i] is not None and inside[parent[i]]
        for i in range(n - 1, -1, -1):
            if own[i]:
                end[i] = end[own[i][-1]]
        place = {id(c): j for x in order for j, c in enumerate(x.children)}
        self.order, self.end, self.leaf, self.inside, self.table, self.own = order, end, leaf, inside, table, own
        lost = self._lost()
        self.texts = [(i, x.data) for i, x in enumerate(order) if x.kind == "text"]
        self.contents = [(i, [c for c in own[i] if order[c].kind == "text"]) for i, x in enumerate(order) if x.kind == "element" and (leaf[i] or ":" in x.tag)]
        self.fixed = [(i, end[i], parent[i], depth[id(x)], place.get(id(x), 0), x.kind, x.tag, x.attrs) for i, x in enumerate(order)]
        self.flags = [(leaf[i], parent[i] is not None and leaf[parent[i]]) for i in range(n)]
        self.lost = lost
        self.emits, self.kept = [], []  # from the last node to the first
        for i in range(n - 1, -1, -1):
            x = order[i]
            if x.kind != "text" and (inside[i] or leaf[i]):
                inline = all(c.kind != "element" or c.tag in INLINE for c in x.children)
                self.emits.append((i, [c for c in own[i] if inline or order[c].kind != "text"], inline, "\n" if x.kind == "element" and x.tag not in INLINE else ""))
        self.parts: list | None = None  # of texts: slots and what is fixed
        self.ids: list[tuple[int, int]] = []
        self.plans: dict = {}  # what else is made once for a layout

    def _lost(self) -> list[bool]:
        """Nodes of decoded elements that are no XML."""
        order, end = self.order, self.end
        lost, until, gone = [False] * len(order), -1, -1
        bad = [0]  # nodes before each that are no XML, inside decoded elements
        for i, n in enumerate(order):
            if n.tag in DECODED:
                until = max(until, end[i])
            bad.append(bad[i] + (i <= until and not _is_xml(n)))
        for i, n in enumerate(order if bad[-1] else ()):
            if i > gone and n.tag in DECODED and bad[end[i] + 1] > bad[i]:
                gone = end[i]
            lost[i] = i <= gone
        return lost

    def slotted(self, n: int) -> bool:
        """Finds the slots in texts and ids; false if one of the ``n`` is not met once, as a text that is not raw or a whole id."""
        parts, met = [], 0
        for i, data in self.texts:
            pieces, at = [], 0
            for m in SLOT.finditer(data):
                if m.start() > at:
                    pieces.append(data[at : m.start()])
                pieces.append(ord(m[0]) - FIRST_SLOT)
                at = m.end()
            if at < len(data):
                pieces.append(data[at:])
            found = sum(isinstance(x, int) for x in pieces)
            if found and self.order[i].parent.tag in RAW:
                return False
            met += found
            parts.append((i, pieces[0], None) if len(pieces) == 1 and found else (i, None, pieces))
        ids = [(i, ord(v) - FIRST_SLOT) for i, x in enumerate(self.order) if x.kind == "element" and len(v := x.attrs.get("id", "")) == 1 and SLOT.match(v)]
        every = sorted([x for _, one, more in parts for x in ([one] if more is None else more) if isinstance(x, int)] + [k for _, k in ids])
        self.parts, self.ids = parts, ids
        return met + len(ids) == n and every == list(range(n))

    def data(self, values: list[str] | None) -> list[str | None]:
        """Texts of nodes by their numbers."""
        out: list[str | None] = [None] * len(self.order)
        if values is None:
            for i, data in self.texts:
                out[i] = data
        else:
            for i, slot, more in self.parts:
                out[i] = values[slot] if more is None else "".join([values[x] if isinstance(x, int) else x for x in more])
        return out

    def _within(self, tags: frozenset[str]) -> tuple[list[int], list[bool]]:
        """Nodes in elements of ``tags``, from the last to the first, and which those elements are."""
        if ("within", tags) not in self.plans:
            until, found = -1, []
            for i, x in enumerate(self.order):
                if x.tag in tags:
                    until = max(until, self.end[i])
                if i <= until:
                    found.append(i)
            self.plans["within", tags] = found[::-1], [x.tag in tags for x in self.order]
        return self.plans["within", tags]

    def rows(self, values: list[str] | None, marked: frozenset[str] = TABLES) -> list[tuple]:
        """The node table; elements of ``marked`` come with their markup."""
        texts = self.data(values)
        fixed = self.fixed
        if values is not None and self.ids:
            fixed = list(fixed)
            for i, k in self.ids:
                fixed[i] = (*fixed[i][:7], fixed[i][7] | {"id": values[k]})
        n = len(fixed)
        content: list[str | None] = [None] * n
        for i, own in self.contents:
            content[i] = texts[own[0]] if len(own) == 1 else "".join([texts[c] for c in own])
        emit = [x if x is not None else "" for x in texts]
        for i, own, inline, tail in self.emits:
            text = "".join([emit[c] for c in own])
            emit[i] = (" ".join(text.split()) if inline else text) + tail
        outer: list[str | None] = [None] * n
        within, own_markup = self._within(marked)
        for i in within:
            outer[i] = _markup(self.order[i], [outer[c] or "" for c in self.own[i]], texts[i], fixed[i][7])
        order, table, lost = self.order, self.table, self.lost
        return [
            (*fixed[i], texts[i] if texts[i] is not None else order[i].data, content[i], leaf, below, emit[i] if leaf or table[i] else None, outer[i] if own_markup[i] else None, lost[i])
            for i, (leaf, below) in enumerate(self.flags)
        ]


_layouts: dict[str, Layout | None] = {}


@lru_cache(4096)
def _is_whole(piece: str) -> bool:
    return WHOLE.fullmatch(piece) is not None


def layout(source: str | None) -> tuple[Layout, list[str] | None]:
    """The layout of a document and the texts of its slots, None if the layout holds its texts itself.

    Texts without ``<`` change no tree, but for whether they are blank: in their places stand single characters while a layout is
    parsed, so what was parsed once serves all documents that differ in such texts alone.
    """
    source = source or ""
    if len(source) <= LONGEST and "&#" not in source and not SLOT.search(source) and not NO_CHARACTER.search(source):
        pieces, values = PIECES.split(source), []
        for j, piece in enumerate(pieces):
            if j % 2:
                if ' id="' in piece and (m := ID.fullmatch(piece)):
                    pieces[j] = f"{m[1]}{chr(FIRST_SLOT + len(values))}{m[3]}"
                    values.append(m[2])
                elif ('"' in piece or "'" in piece) and not _is_whole(piece):
                    break
                continue
            if not piece:
                continue
            if "<" in piece:
                break
            text = unescape(piece) if "&" in piece else piece
            if bare := text.lstrip(BLANK):
                pieces[j] = f"{text[: len(text) - len(bare)]}{chr(FIRST_SLOT + len(values))}"
                values.append(bare)
        else:
            if len(values) <= SLOTS:
                key = "".join(pieces)
                if key not in _layouts:
                    if len(_layouts) >= LAYOUTS:
                        _layouts.clear()
                    own = Layout(tree(key))
                    _layouts[key] = own if own.slotted(len(values)) else None
                if (known := _layouts[key]) is not None:
                    return known, values
    return Layout(tree(source)), None


def rows(source: str | None) -> list[tuple]:
    """The node table of a document, in pre-order."""
    own, values = layout(source)
    return own.rows(values)


def _is_xml(node: Node) -> bool:
    """Whether a node by itself, written out as markup, can be read as XML. Raw text is not escaped there."""
    if node.kind == "comment":
        return "--" not in node.data and not node.data.endswith("-")
    if node.kind == "text":
        return not NO_CHARACTER.search(node.data) and not (node.parent.tag in RAW and ("<" in node.data or "&" in node.data))
    return node.kind != "element" or all(NAME.fullmatch(k) for k in (node.tag, *node.attrs)) and not any(NO_CHARACTER.search(v) for v in node.attrs.values())


def _markup(node: Node, inner: list[str], text: str | None, own: dict | None) -> str:
    if node.kind == "text":
        return text if node.parent is not None and node.parent.tag in RAW else escape(text, quote=False)
    if node.kind == "comment":
        return f"<!--{node.data}-->"
    attrs = "".join(f' {k}="{escape(v)}"' for k, v in own.items())
    return f"<{node.tag}{attrs}/>" if node.tag in VOID else f"<{node.tag}{attrs}>{''.join(inner)}</{node.tag}>"


def parse_html(docs: DataFrame, keys: list[str], html_col: str, tasks: int | None = None, only: frozenset[str] | None = None) -> DataFrame:
    """``keys`` and the node columns: the only step that leaves the JVM. ``tasks``: documents are dealt out first, as parsing is costly and they may come in few partitions.
    ``only``: the tags and kinds of nodes that are wanted; no others are sent."""
    fields = [x.split()[0] for x in NODES.replace("map<string,string>", "map").split(", ")]
    kinds = [pa.int32()] * 5 + [pa.string()] * 2 + [pa.map_(pa.string(), pa.string())] + [pa.string()] * 2 + [pa.bool_()] * 2 + [pa.string()] * 2 + [pa.bool_()]

    def flush(heads: list[list], found: list[tuple], types: list) -> pa.RecordBatch:
        columns = zip(*found, strict=True) if found else [[] for _ in kinds]
        columns = [[list(x.items()) if isinstance(x, dict) else x for x in c] if k == 7 else list(c) for k, c in enumerate(columns)]
        return pa.RecordBatch.from_arrays([*(pa.array(h, t) for h, t in zip(heads, types, strict=True)), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], [*keys, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = [batch.schema.field(k).type for k in range(len(keys))]
            heads, out = [[] for _ in keys], []
            own = [batch.column(k).to_pylist() for k in range(len(keys))]
            for i in range(batch.num_rows):
                raw = batch.column(len(keys))[i].as_py()
                found = rows(raw.decode(errors="replace") if isinstance(raw, bytes) else raw)
                if only is not None:
                    found = [x for x in found if x[6] in only or x[5] in only]
                for lo in range(0, len(found), 20_000):
                    part = found[lo : lo + 20_000]
                    out += part
                    for h, values in zip(heads, own, strict=True):
                        h += [values[i]] * len(part)
                    if len(out) >= 20_000:
                        yield flush(heads, out, types)
                        heads, out = [[] for _ in keys], []
            yield flush(heads, out, types)

    given = docs.select(*keys, F.col(html_col))
    given = given.repartition(tasks) if tasks else given
    own = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return given.mapInArrow(run, f"{own}, {NODES}")


def leaf_texts(nodes: DataFrame, predicate: Callable[[Column], Column] | None = None) -> DataFrame:
    """Leaves in document order with their text, where it is not empty; ``predicate`` gives what to keep of the text (null: nothing)."""
    out = nodes.where("is_leaf and not parent_is_leaf").withColumn("text", trimmed(F.col("emit"))).where("text <> ''")
    return out if predicate is None else out.withColumn("match", predicate(F.col("text"))).where("match is not null and match <> ''")


def tables_where(nodes: DataFrame, predicate: Callable[[Column], Column]) -> DataFrame:
    """Tables whose text fits, nested ones too."""
    out = nodes.where("kind = 'element' and tag = 'table'").withColumn("text", trimmed(F.col("emit")))
    return out.where((F.col("text") != "") & predicate(F.col("text")))


def _escaped(text: Column, quote: bool = False) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"), ("'", "&#x27;")) if quote else ())):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def markup(nodes: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node_id, markup) for nodes of any kind, ``wanted`` (keys, node_id, subtree_end): what stands in their intervals, as ordered openings and closings.

    An element opens at its own number and closes behind the last of its subtree, the deepest of those that end there first. Both sides
    meet by document; nested ones that are wanted are each written out. A document's own node gives its children.
    """
    tags = nodes.select(*keys, F.col("node_id").alias("parent_id"), F.col("tag").alias("_of")).where(F.col("_of").isin(*RAW))
    own = nodes.select(*keys, "node_id", "subtree_end", "parent_id", "depth", "kind", "tag", "attrs", "data").join(tags, [*keys, "parent_id"], "left")
    attrs = F.array_join(F.transform(F.map_entries("attrs"), lambda x: F.concat(F.lit(" "), x["key"], F.lit('="'), _escaped(x["value"], True), F.lit('"'))), "")
    void = F.coalesce(F.col("tag").isin(*VOID), F.lit(False))
    element = F.col("kind") == "element"
    opening = (
        F.when(element, F.concat(F.lit("<"), "tag", F.coalesce(attrs, F.lit("")), F.when(void, F.lit("/>")).otherwise(F.lit(">"))))
        .when(F.col("kind") == "text", F.when(F.col("_of").isNull(), _escaped(F.col("data"))).otherwise(F.col("data")))
        .when(F.col("kind") == "comment", F.concat(F.lit("<!--"), "data", F.lit("-->")))
        .otherwise(F.lit(""))
    )
    event = lambda at, last, depth, text: F.struct(at.alias("at"), F.lit(last).alias("last"), depth.alias("depth"), text.alias("text"))
    none = F.lit(0)
    events = F.filter(F.array(event(F.col("node_id"), 0, none, opening), F.when(element & ~void, event(F.col("subtree_end"), 1, -F.col("depth"), F.concat(F.lit("</"), "tag", F.lit(">"))))), lambda x: x.isNotNull())
    parts = own.select(*keys, F.col("node_id").alias("_n"), F.explode(events).alias("e"))
    inside = wanted.select(*keys, "node_id", F.col("subtree_end").alias("_end")).join(parts, keys).where("_n >= node_id and _n <= _end")
    return inside.groupBy(*keys, "node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["text"]), "").alias("markup"))
