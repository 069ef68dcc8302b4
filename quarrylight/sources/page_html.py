"""Web pages to title, section, date, main text and attachments, by ordered selectors.

A page is parsed into a light tree; a selector is a chain of compound parts
(tag, #id, .class, [attribute], [attribute='v'], [attribute*='v']) where each
part stands somewhere below the one before.  Which selectors count, and in which
order, is data: `Rules`.  Removing an element marks it, so the tree stays whole
for whatever is read next.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date
from html.parser import HTMLParser
from pathlib import PurePosixPath
from urllib.parse import unquote, urljoin, urlsplit

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "table", "section", "article", "ul", "ol", "dt", "dd", "blockquote", "main", "body"}
#: Tags that end an open one of their kind.
CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}


@dataclass(frozen=True)
class Rules:
    """What one site's pages look like; values of the site that must be met are the defaults."""

    # Selectors in their order.
    headings: tuple[str, ...] = ("#ajax-page-content h1", "#ajax-page-content h2", "#ajax-page-content h3", ".page-content h1", ".page-content h2", ".page-content h3", "article h1", "article h2", "article h3", "#maincontent h1", "#maincontent h2", "#maincontent h3", "main h1", "main h2")
    breadcrumbs: tuple[str, ...] = (".breadcrumb", ".breadcrumbs", ".bx-breadcrumb", ".breadcrumb-list", ".breadcrumb__list", "[itemtype*='BreadcrumbList']")
    legal_containers: tuple[str, ...] = ("#maincontent", ".content#maincontent", ".page-content", ".content", "main")
    press_containers: tuple[str, ...] = ("#ajax-page-content", ".item-detail-content", "article.item-detail-text", "article", ".page-content", "#maincontent", ".content")
    containers: tuple[str, ...] = ("#ajax-page-content", "article.item-detail-text", "article", "main", "[role='main']", "#maincontent", "#content", ".page-content", ".content-page", ".main-content", ".news-detail", ".detail", ".text", ".content")
    removed: tuple[str, ...] = ("script", "style", "noscript", "template", "svg", "nav", "header", "footer", "aside", "form", ".breadcrumb", ".breadcrumbs", "[class*='breadcrumb']", ".main-nav-container", ".main-mobile", ".footer-menu", ".menu", ".sidebar", ".social", ".share", ".cookie", ".cookie-notification", "#hidden-content", ".pagination", ".print-link", ".hidden-lg.hidden-md.hidden-sm")
    press_removed: tuple[str, ...] = (".detail-content-date", ".detail-content-small-info", ".detail-content-footer", ".btn_obs", ".modalop", ".buttons-rule", "a.share", ".share")
    # Phrases and path parts.
    press_phrases: tuple[str, ...] = ("Перейти к обсуждению", "Поделиться")
    home_names: tuple[str, ...] = ("главная", "главная страница")
    title_prefixes: tuple[str, ...] = ("Администрация города Сочи -", "Администрация города Сочи —")
    download_words: tuple[str, ...] = (".pdf", "скачать документ", "скачать файл")
    legal_path: str = "normativno-pravovyye-akty"
    press_paths: tuple[str, ...] = ("/press-sluzhba/novosti/", "/press-sluzhba/obyavleniya/")
    sections: dict[str, str] = field(default_factory=lambda: {"/press-sluzhba/novosti/": "Пресс-служба / Новости", "/press-sluzhba/obyavleniya/": "Пресс-служба / Объявления", "/press-sluzhba/": "Пресс-служба"})
    legal_section: str = "Городская власть / Официальное опубликование муниципальных правовых актов"
    date_element: str = "time.detail-content-date"
    date_label: str = "Опубликовано на сайте"

    def kind(self, url: str) -> str:
        """legal, press or other: which container list a page has."""
        parts = urlsplit(url)
        if self.legal_path in parts.path.lower() and "element_id=" in parts.query.lower():
            return "legal"
        return "press" if any(p in parts.path.lower() for p in self.press_paths) else "other"


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "removed")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.removed = tag, attrs, parent, False
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """All nodes below that aren't removed, in the order of the page."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            node = todo.pop()
            if not node.removed:
                yield node
                todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def strings(self, breaks: bool = False) -> Iterator[str]:
        todo: list[Node | str] = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                yield x
            elif not x.removed:
                ends = ["\n"] if breaks and x.tag in BLOCKS else []
                todo += [*ends, *reversed(x.children), *ends]

    def text(self) -> str:
        """The words below, one blank between them."""
        return " ".join(" ".join(self.strings()).split())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.at.tag in CLOSES.get(tag, ()):
            self.at = self.at.parent or self.root
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        node: Node | None = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(page: str) -> Node:
    builder = _Builder()
    builder.feed(page)
    builder.close()
    return builder.root


_PART = re.compile(r"#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<name>[\w:-]+)(?:(?P<op>\*?=)'(?P<value>[^']*)')?\]|(?P<tag>[a-z][\w]*)")


def _fits(node: Node, part: str) -> bool:
    for m in _PART.finditer(part):
        a = node.attrs
        if m["tag"] and node.tag != m["tag"] or m["id"] and a.get("id") != m["id"] or m["cls"] and m["cls"] not in a.get("class", "").split():
            return False
        if m["name"] and (m["name"] not in a or m["op"] == "=" and a[m["name"]] != m["value"] or m["op"] == "*=" and m["value"] not in a[m["name"]]):
            return False
    return True


def select(root: Node, selector: str) -> Iterator[Node]:
    *above, last = selector.split()
    for node in root.walk():
        if not _fits(node, last):
            continue
        left, up = list(above), node.parent
        while left and up is not None:
            if _fits(up, left[-1]):
                left.pop()
            up = up.parent
        if not left:
            yield node


def first(root: Node, selectors: tuple[str, ...]) -> Node | None:
    """The first node of the first selector that has one."""
    return next((node for s in selectors for node in select(root, s)), None)


def lines(text: str) -> str:
    """Single blanks within lines, no empty lines."""
    return "\n".join(x for x in (re.sub(r"[ \t\xa0\f\v]+", " ", y).strip() for y in re.split(r"\r\n?|\n", text)) if x)


def file_name(url: str) -> str:
    return PurePosixPath(unquote(urlsplit(url).path)).name or "Документ"


def title(root: Node, url: str, rules: Rules) -> str:
    """Heading, og:title, the page's title, the file name: the first that says something."""

    def clean(text: str) -> str:
        text = " ".join(text.split())
        for p in rules.title_prefixes:
            text = text[len(p) :].strip() if text.lower().startswith(p.lower()) else text
        return text

    heading = first(root, rules.headings)
    found = [clean(heading.text()) if heading else ""]
    found[0] = found[0] if len(found[0]) <= 1000 else ""
    found += [clean(m.attrs.get("content", "")) for m in list(select(root, "meta[property='og:title']"))[:1]]
    found += [clean(t.text()) for t in list(select(root, "title"))[:1]]
    return next((t for t in found if t), "") or file_name(url)


def section(root: Node, heading: str, url: str, rules: Rules) -> str:
    """The links of the breadcrumbs, without the home page and the page itself, if they are short; else what the path tells."""
    crumbs = first(root, rules.breadcrumbs)
    names = [a.text() for a in select(crumbs, "a")] if crumbs else []
    skip = {*rules.home_names, " ".join(heading.split()).lower(), ""}
    joined = " / ".join(dict.fromkeys(n for n in names if n.lower() not in skip))
    if 0 < len(joined) <= 300:
        return joined
    if rules.kind(url) == "legal":
        return rules.legal_section
    return next((name for p, name in rules.sections.items() if p in urlsplit(url).path.lower()), "")


def container(root: Node, url: str, rules: Rules) -> Node:
    lists = {"legal": rules.legal_containers, "press": rules.press_containers, "other": rules.containers}
    return first(root, lists[rules.kind(url)]) or first(root, ("body",)) or root


def published(root: Node, rules: Rules) -> str | None:
    """An ISO date from the date element; "label: ..." text is left to the column rules (`functions.legal`)."""
    element = first(root, (rules.date_element,))
    raw = (element.attrs.get("datetime") or element.text()).strip()[:10] if element else ""
    try:
        return date.fromisoformat(raw).isoformat() if len(raw) == 10 else None
    except ValueError:
        return None


def clean(box: Node, url: str, heading: str, rules: Rules) -> None:
    """Mark what isn't content below a container."""
    press = rules.kind(url) == "press"
    for s in (*rules.removed, *(rules.press_removed if press else ())):
        for node in list(select(box, s)):
            node.removed = True
    if not press:
        return
    same = " ".join(heading.split()).lower()
    for node in box.walk():
        if same and node.tag in ("h1", "h2", "h3") and node.text().lower() == same:
            node.removed = True
            break
    phrases = {p.lower() for p in rules.press_phrases}
    for node in list(box.walk()):
        if any(isinstance(c, str) and " ".join(c.split()).lower() in phrases for c in node.children):
            node.removed = True


def attachments(box: Node, url: str, rules: Rules) -> list[tuple[str, str]]:
    """(absolute link, title) of links to PDF files, as they are named or called; of one link the last title counts."""
    found: dict[str, str] = {}
    for a in select(box, "a[href]"):
        href, text = a.attrs["href"].strip(), a.text()
        try:
            full = urljoin(url, href) if href else ""
            path = urlsplit(full).path.lower()
        except ValueError:
            continue
        if full.startswith(("http://", "https://")) and (path.endswith(".pdf") or any(w in text.lower() for w in rules.download_words)):
            full = full.split("#")[0]
            found.pop(full, None)
            found[full] = text or PurePosixPath(path).name or "PDF"
    return list(found.items())


def links(root: Node, url: str) -> list[tuple[str, str]]:
    return list({a.attrs["href"]: (a.attrs["href"], a.text()) for a in select(root, "a[href]") if a.attrs["href"]}.values())


def read(page: str, url: str, rules: Rules | None = None) -> dict:
    """title, section, published, pages, links, attachments of one page."""
    rules = rules or Rules()
    root = parse(page)
    heading = title(root, url, rules)
    out = {"title": heading, "section": section(root, heading, url, rules), "published": published(root, rules), "links": links(root, url)}
    box = container(root, url, rules)
    out["attachments"] = attachments(box, url, rules)
    clean(box, url, heading, rules)
    return out | {"pages": [lines("".join(box.strings(breaks=True)))]}
