"""Main text by two-pass block rules: density, length and links decide a block, undecided short ones follow their nearest decided neighbours.

Null or empty html gives an empty text.
"""
import html
import re

# Frequent function words.
STOP = set("the of and to in a is that it for was on are as with he be at by this de la que el en y los las un una le les des et du est pour dans qui der die das und ist von zu den mit nicht ein eine".split())
# Elements whose content is never main text, and elements inside a line.
SKIP = {"script", "style", "nav", "footer", "aside", "form", "head", "header", "noscript", "template", "button", "select", "textarea", "iframe", "svg"}
INLINE = {"a", "b", "i", "em", "strong", "span", "u", "s", "sub", "sup", "small", "code", "mark", "abbr", "q", "cite", "font", "time", "wbr", "img"}
VOID = {"br", "img", "hr", "meta", "link", "input", "wbr", "area", "base", "col", "embed", "param", "source", "track"}
RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
# A tag ends at the first > outside quotes, or at the first at all where a quote stays open.
TAG = re.compile(r"""<(/?)([a-zA-Z][\w-]*)((?:"[^"]*"|'[^']*'|[^'">])*+>|[^>]*>)|<![^>]*>""")
WIDE = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]+")
NOTICE = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# Whole class, id or role names of what is never main text, and elements that no name makes a notice.
NAMES = re.compile(r"ads?|advert\w*|(?:cookie|promo|share|newsletter)(?:-?(?:banner|notice|bar|box))?|banner|cookies|comments?|sidebar|menu|notice|related|navigation", re.I)
MAIN = {"html", "body", "main", "article"}
# Start tags and end tags of a parent that end an element without an end tag of its own.
FLOW = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {
    "p": FLOW, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "optgroup": {"optgroup"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "tr": {"tr", "tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "thead": {"tbody", "tfoot"}, "head": {"body"},
}
# Elements inside which a start tag belongs to a new list or table, not to the skipped one.
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, **dict.fromkeys(("td", "th", "tr", "tbody", "thead"), {"table"}), "option": {"select"}, "optgroup": {"select"}}


def noticed(attributes):
    """Whether a whole class, id or role name is that of a notice."""
    return any(NAMES.fullmatch(t) for m in NOTICE.finditer(attributes) for t in (m[1] or m[2] or m[3] or "").split())


def blocks(page):
    """(text, link characters, in article, heading) in page order."""
    out, parts, links, anchors, article, skipped = [], [], 0, 0, 0, []
    state, around = False, []

    def close():
        nonlocal parts, links
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((text, links, article > 0, state))
        parts, links = [], 0

    page, at = RAW.sub(" ", page), 0
    tags = [*TAG.finditer(page)]
    # Where an element is closed for the last time; one that is never closed is not skipped, unless its end tag may be left out
    # or its parent's ends it.
    closed = {m[2].lower(): m.start() for m in tags if m[1]}
    for m in [*tags, None]:
        data = page[at : m.start() if m else len(page)]
        if not skipped and data:
            parts.append(data)
            links += len(data.strip()) * (anchors > 0)
        if m is None:
            break
        at = m.end()
        if not m[2]:
            continue
        end, name = bool(m[1]), m[2].lower()
        if skipped:
            if end:
                if name in skipped:
                    # An end tag also ends what is open inside its element.
                    del skipped[len(skipped) - 1 - skipped[::-1].index(name) :]
                    continue
                # One of an element around the skipped one ends that too.
                if name not in around:
                    continue
                skipped.clear()
            else:
                while skipped and name in CLOSED_BY.get(skipped[-1], ()):
                    skipped.pop()
                if skipped:
                    # Of the elements inside, a start tag ends the last of its kind in the same list or table.
                    k = len(skipped) - 1
                    while k >= 0 and name not in CLOSED_BY.get(skipped[k], ()) and skipped[k] not in SCOPE.get(name, ()):
                        k -= 1
                    if k >= 0 and name in SCOPE and name in CLOSED_BY.get(skipped[k], ()):
                        del skipped[k:]
                if skipped:
                    if name not in VOID:
                        skipped.append(name)
                    continue
        while around and not end and name in CLOSED_BY.get(around[-1], ()):
            around.pop()
        if name not in INLINE:
            close()
            state = bool(re.fullmatch("h[1-6]", name)) and not end
        if not end and name not in VOID and (name in SKIP and not (name == "header" and article) or name not in MAIN and noticed(m[3])) and (name in CLOSED_BY or closed.get(name, -1) > at or around and around[-1] not in MAIN and closed.get(around[-1], -1) > at):
            close()
            skipped.append(name)
            continue
        elif name == "a":
            anchors = max(0, anchors + (-1 if end else 1))
        elif name == "article":
            article = max(0, article + (-1 if end else 1))
        if end and name in around:
            del around[len(around) - 1 - around[::-1].index(name) :]
        elif not end and name not in VOID and name not in INLINE:
            around.append(name)
    close()
    return out


def main_text(page):
    found = blocks(page or "")
    marks = []
    # Where the page's text is in none of the languages of STOP, length and links alone decide.
    running = [w.strip(".,;:!?") for text, links, _, _ in found if links <= 0.5 * len(text) for w in text.lower().split()]
    fits = sum(w in STOP for w in running) >= 0.1 * len(running)
    wide = sum(map(len, WIDE.findall("".join(running))))
    # Scripts without spaces say as much in fewer characters.
    long = 50 if wide > 0.3 * sum(map(len, running)) else 140
    for text, links, inside, heading in found:
        words = text.lower().split()
        dense = sum(w.strip(".,;:!?") in STOP for w in words) / len(words)
        if links > 0.5 * len(text):
            # Links in an article are part of it where its other blocks are.
            marks.append(None if inside else False)
        elif inside or len(text) >= long and (dense >= 0.1 or not fits):
            marks.append(True)
        else:
            marks.append(False if len(text) >= long else None)
    kept = []
    left, before = None, []
    for mark in marks:
        left = mark if mark is not None else left
        before.append(left)
    right, after = None, [None] * len(marks)
    for i in range(len(marks) - 1, -1, -1):
        right = marks[i] if marks[i] is not None else right
        after[i] = right
    for i, (text, _, _, heading) in enumerate(found):
        near = (before[i], after[i])
        if marks[i] or marks[i] is None and (all(x is not False for x in near) and any(near) or heading and after[i]):
            kept.append(text)
    return "\n".join(kept)


def extract(pages):
    def run(batches):
        import pandas as pd

        for pdf in batches:
            texts = [main_text(x) for x in pdf.html]
            yield pd.DataFrame({"page_id": pdf.page_id, "url": pdf.url, "text": texts, "n_chars": [len(x) for x in texts]})

    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")
