"""Small HTML readers used inside Arrow batches; everything around them stays in Spark.

A page is first turned into a flat list of events. Questions are then answered over that list: which events lie in
hidden ranges, how deep each event is in content and text elements, and which texts stand between the two ends of
an anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from itertools import accumulate, islice, pairwise
from typing import NamedTuple
from urllib.parse import urldefrag, urljoin

from voxlake import constants as K


class Event(NamedTuple):
    """A start tag (kind 1), an end tag (kind -1) or a text (kind 0, in `name`)."""

    kind: int
    name: str
    attributes: dict[str, str]


class _Recorder(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.events: list[Event] = []

    def handle_starttag(self, tag, attrs):
        self.events.append(Event(1, tag, {name: value or "" for name, value in attrs}))

    def handle_endtag(self, tag):
        self.events.append(Event(-1, tag, {}))

    def handle_data(self, data):
        if data.strip():
            self.events.append(Event(0, data, {}))


def page_events(html: str | None) -> list[Event]:
    recorder = _Recorder()
    recorder.feed(html or "")
    return recorder.events


def _hints(event: Event, *attributes: str) -> str:
    return " ".join(event.attributes.get(a, "").lower() for a in attributes)


def _is_hidden(event: Event) -> bool:
    return event.name in K.SKIP_TAGS or any(h in _hints(event, "class", "id", "role") for h in K.BOILERPLATE_HINTS)


def _is_content(event: Event) -> bool:
    return (event.name in K.CONTENT_TAGS or _hints(event, "role") == "main"
            or any(h in _hints(event, "class", "id") for h in K.CONTENT_HINTS))


def element_end(events: list[Event], start: int) -> int:
    """The index behind the end tag that closes the element that starts there (unclosed: behind the last event).

    An end tag closes the innermost open element of its name and all within; end tags without one are passed over.
    """
    open_: list[str] = []
    for i in range(start, len(events)):
        kind, name, _ = events[i]
        if kind > 0 and name not in K.VOID_TAGS and name != "meta":
            open_.append(name)
        elif kind < 0 and name in open_:
            del open_[len(open_) - 1 - open_[::-1].index(name):]
            if not open_:
                return i + 1
    return len(events)


def visible(events: list[Event]) -> Iterator[Event]:
    """The events outside boilerplate elements."""
    at = 0
    while at < len(events):
        event = events[at]
        if event.kind > 0 and event.name not in K.VOID_TAGS and event.name != "meta" and _is_hidden(event):
            at = element_end(events, at)
        else:
            yield event
            at += 1


def _depths(events: list[Event], opens: Callable[[Event], bool], closes: tuple[str, ...]) -> Iterator[int]:
    """How many elements of a kind are open at each event; an end tag too many changes nothing."""
    steps = (int(e.kind > 0 and e.name not in K.VOID_TAGS and opens(e)) - int(e.kind < 0 and e.name in closes) for e in events)
    return islice(accumulate(steps, lambda depth, step: max(depth + step, 0), initial=0), 1, None)


def readable(events: list[Event]) -> list[str]:
    """Texts in content or text elements, outside boilerplate."""
    shown = list(visible(events))
    content = _depths(shown, _is_content, K.CONTENT_TAGS)
    text = _depths(shown, lambda e: e.name in K.TEXT_TAGS, K.TEXT_TAGS)
    return [e.name for e, c, t in zip(shown, content, text, strict=True) if e.kind == 0 and (c or t)]


def metas(events: list[Event]) -> dict[str, str]:
    """Content of the meta tags by property or name; the last of a name counts."""
    named = ((_hints(e, "property" if e.attributes.get("property") else "name").strip(), e.attributes.get("content", "").strip())
             for e in events if e.kind > 0 and e.name == "meta")
    return {name: content for name, content in named if name and content}


def titles(events: list[Event]) -> list[str]:
    """Texts that follow a title's start with no title's end between."""
    inside = accumulate((e.kind if e.kind and e.name == "title" else 0 for e in events), lambda last, now: now or last)
    return [e.name for e, state in zip(events, inside, strict=True) if e.kind == 0 and state > 0]


def anchors(events: list[Event]) -> list[tuple[str, str]]:
    """(href, text) of closed anchors; a title attribute comes before the text."""
    ends = [i for i, e in enumerate(events) if e.kind and e.name == "a"]
    out = []
    for start, end in pairwise(ends):
        attributes = events[start].attributes
        if events[start].kind > 0 and events[end].kind < 0 and attributes.get("href"):
            texts = (e.name.strip() for e in events[start:end] if e.kind == 0)
            out.append((attributes["href"], " ".join(filter(None, (attributes.get("title"), *texts))).strip()))
    return out


def _squeeze(parts: list[str]) -> str:
    return " ".join(" ".join(parts).split())


def read_article(html: str | None) -> tuple[str | None, str | None, str | None, str]:
    """(title, author, published, content) of one page."""
    events = page_events(html)
    meta = metas(events)

    def first(names: tuple[str, ...]) -> str | None:
        return next((meta[n] for n in names if n in meta), None)

    author = first(K.AUTHOR_META)
    return (
        _squeeze([first(K.TITLE_META) or _squeeze(titles(events))]) or None,
        _squeeze([author]) if author else None,
        first(K.PUBLISHED_META),
        _squeeze(readable(events)),
    )


def read_links(base: str | None, html: str | None) -> list[tuple[str, str]]:
    """(absolute link without fragment, anchor text) in page order, web links only."""
    out = []
    for href, text in anchors(page_events(html)):
        try:
            link = urldefrag(urljoin(base or "", href)).url
        except ValueError:
            continue
        if link.lower().startswith(("http:", "https:")):
            out.append((link, text))
    return out
