"""Main text of web pages by a tree-structured graphical model.

Every page becomes its DOM tree. Each node is content or not; the chance of that given its
parent depends on the tag (parent-child potentials), and class, id and role words and text
shape add evidence per node. Messages go up the tree and down again (sum-product), which
gives every node's exact marginal; text nodes over one half are the main text.

The potentials are counts from labelled pages: a few with marked content (``MARKED_PAGES``),
and a bounded sample of the table's own pages whose article element tells the label.
"""

from __future__ import annotations

import math
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import whole_text

SAMPLE_PAGES = 500  # pages of the table used for training, about

# Parts of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template iframe button select textarea datalist".split())
HEAD_TAGS = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
BLOCKS = frozenset(("address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form "
                    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary "
                    "table tbody td tfoot th thead tr ul").split())
#: an open element is closed by the start of one of these
CLOSED_BY = {
    "p": BLOCKS - frozenset("body caption dd dt html legend li option tbody td tfoot th thead tr".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "head": frozenset(["body"]),
}
#: beyond these an open element is not looked for
SCOPE = frozenset("ul ol table dl select td th html body article section div aside nav main footer header form".split())
MAIN_TAGS = frozenset(["article", "main"])
BOILER_TAGS = frozenset("nav aside footer form button menu dialog".split())

# Labelled pages: data-main marks what is content (1) or not (0); inner elements inherit it.
_BODY = "<p>A first long paragraph of the story, with commas, and an end.</p><p>Another one with <a href=x>a link</a> and <b>bold</b> or <em>stressed</em> words.</p>"
_SIDES = ("<div class='{0}'><p>Some words here.</p><ul><li><a href=x>one</a></li><li><a href=x>two</a></li></ul></div>"
          "<section class='{0}'><h3>Title</h3><p>Words, words.</p></section><div id='{0}'><span>Short</span></div>")
_OUTSIDE = ("ad ads advert advertisement sponsored sponsor promo promotion banner|cookie cookies consent notice gdpr alert popup modal overlay|"
            "sidebar side widget rail related recommended trending popular teaser|comment comments reply replies discussion respond disqus|"
            "menu nav navbar navigation breadcrumb breadcrumbs pagination toc|footer copyright legal bottom|"
            "header masthead topbar toolbar logo branding|newsletter subscribe signup login register search form|share sharing social follow tags meta")
_FORMULA = "math semantics mrow mstyle mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd mpadded".split()
_LETTERS = "<mi>x</mi><mo>=</mo><mn>1</mn><mtext>if</mtext><ms>s</ms>"
_INSIDE = "article content post entry body text story main articlebody postcontent prose markdown"


def marked_pages() -> list[str]:
    """The labelled pages, one per word that names a kind of part, in and around content."""
    pages = []
    for word in _INSIDE.split():
        pages.append(f"<html><body data-main=0><header><a href=x>Home</a></header><nav><ul><li><a href=x>one</a></li></ul></nav>"
                     f"<div class=page><div class='{word}' data-main=1><h1>Heading</h1>{_BODY}<h2>More</h2><ul><li>An item of a list.</li></ul>"
                     f"<blockquote>Quoted.</blockquote><pre>code</pre><table><tr><td>cell</td></tr></table></div></div><footer><p>Foot</p></footer></body></html>")
    for group in _OUTSIDE.split("|"):
        for word in group.split():
            part = _SIDES.format(word)
            pages.append(f"<html><body data-main=0><div class=page>{part}<article data-main=1><h1>Heading</h1>{_BODY}<figure><figcaption>What it shows."
                         f"</figcaption></figure><div data-main=0 class='{word}'><p>Some words here.</p></div>{_BODY}<section data-main=0 id='{word}'><h3>Title</h3><p>Words.</p></section>"
                         f"<aside data-main=0><p>Aside</p></aside><nav data-main=0><a href=x>next</a></nav><form data-main=0><input><button>Go</button></form><section data-main=1><h2>Part</h2><p>Text of it.</p>"
                         f"<div data-main=1><p>And more of it.</p></div></section></article>{part}<aside><p>Aside</p></aside><form><label>Name</label><input>"
                         f"<button>Send</button><select><option>a</option></select><textarea>t</textarea></form></div></body></html>")
    formula = "".join(f"<{t}>" for t in _FORMULA) + _LETTERS + "".join(f"</{t}>" for t in reversed(_FORMULA))
    for _ in range(10):  # a formula goes with the text that it stands in
        pages.append(f"<html><body data-main=0><nav><a href=x>{formula}</a></nav><article data-main=1>{_BODY}<p>A rule, {formula} in words.</p></article></body></html>")
    for _ in range(40):  # plain pages: the body itself is the content
        pages.append(f"<html><body data-main=1><nav data-main=0><a href=x>Home</a></nav><h1>Heading</h1>{_BODY}{_BODY}"
                     "<aside data-main=0>Aside</aside><form data-main=0><label>Name</label><input></form><footer data-main=0>Foot</footer></body></html>")
        pages.append(f"<html><body data-main=0><div data-main=1><h1>Heading</h1>{_BODY}{_BODY}</div><div><a href=x>Home</a> <a href=x>Next</a></div></body></html>")
    return pages


class Tree(HTMLParser):
    """The DOM of a page as parallel lists, parents before children; text nodes have tag "#text".

    Character references are decoded; end tags that HTML lets out are supplied, that of head too; comments and
    what is never shown are left out.
    """

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.attrs, self.text = ["#root"], [-1], [{}], [""]
        self.block = [0]  # the number of the block that a text or br belongs to
        self.blocks, self.open, self.unseen, self.links = 0, [0], 0, 0
        self.plain = set()  # the blocks that hold a text outside links
        self.feed(page)
        self.close()

    def _pop(self, to: int) -> None:
        while len(self.open) > to:
            tag = self.tag[self.open.pop()]
            self.unseen -= tag in UNSEEN
            self.links -= tag == "a"
            self.blocks += tag in BLOCKS and not self.unseen

    def _find(self, wanted, stop) -> int | None:
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.open[k]]
            if wanted(tag):
                return k
            if tag in stop:
                return None
        return None

    def _leave_head(self, inside=frozenset(["template", "title", "noscript"])) -> None:
        if self.unseen and (k := self._find(lambda t: t == "head", inside)) is not None:
            self._pop(k)

    def handle_starttag(self, tag, attrs):
        if tag not in HEAD_TAGS:
            self._leave_head(frozenset(["template", "title"]))
        if tag in BLOCKS or tag in CLOSED_BY["td"]:
            while (k := self._find(lambda t: tag in CLOSED_BY.get(t, ()), SCOPE)) is not None:
                self._pop(k)
            self.blocks += not self.unseen
        self.tag.append(tag)
        self.parent.append(self.open[-1])
        self.attrs.append({k: v or "" for k, v in attrs})
        self.text.append("")
        self.block.append(self.blocks if tag == "br" else 0)
        if tag not in VOID:
            self.open.append(len(self.tag) - 1)
            self.unseen += tag in UNSEEN
            self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # in HTML a slash closes nothing, in formulas and drawings it does
        if tag not in VOID and self._find(lambda t: t in ("svg", "math"), ()) is not None:
            self._pop(len(self.open) - 1)

    def handle_endtag(self, tag):
        if (k := self._find(lambda t: t == tag, ())) is not None:
            self._pop(k)

    def handle_data(self, data):
        if self.tag[self.open[-1]] == "head" and data.strip():
            self._leave_head()
        if self.unseen:
            return
        self.tag.append("#text")
        self.parent.append(self.open[-1])
        self.attrs.append({})
        self.text.append(data)
        self.block.append(self.blocks)
        if not self.links and any(c.isalnum() for c in data):
            self.plain.add(self.blocks)

    def words(self, i: int) -> list[str]:
        """The words of a node's class, id and role."""
        a = self.attrs[i]
        if not a:
            return []
        out = "".join(c if c.isalnum() else " " for c in " ".join([a.get("class", ""), a.get("id", ""), a.get("role", "")]).lower())
        return sorted(set(out.split()))

    def shape(self, i: int) -> str:
        """A coarse shape of a text: its length, whether it has sentence marks, whether its block is links alone."""
        t = self.text[i].strip()
        marks = "." if any(c in t for c in ".!?;") else "-"
        return f"{min(6, len(t).bit_length() // 2)}{marks}{'' if self.block[i] in self.plain else 'a'}"


def labels(tree: Tree) -> list[int] | None:
    """Content or not for each node: by data-main marks, else by an article or main element; None if
    the page has neither."""
    marked = any("data-main" in a for a in tree.attrs)
    if not marked and not any(t in MAIN_TAGS for t in tree.tag):
        return None
    out = [0] * len(tree.tag)
    for i in range(1, len(tree.tag)):
        out[i] = out[tree.parent[i]]
        if marked:
            out[i] = int(tree.attrs[i].get("data-main", out[i]))
        elif tree.tag[i] in MAIN_TAGS:
            out[i] = 1
        elif tree.tag[i] in BOILER_TAGS:
            out[i] = 0
    return out


def count_page(page: str):
    """Yield (kind, key, label of the parent, label) of a labelled page's nodes."""
    tree = Tree(page)
    y = labels(tree)
    if y is None:
        return
    for i in range(1, len(tree.tag)):
        if tree.tag[i] == "#text" and not tree.text[i].strip():
            continue
        yield "tag", tree.tag[i], y[tree.parent[i]], y[i]
        for w in tree.words(i):
            yield "word", w, 0, y[i]
        if tree.tag[i] == "#text":
            yield "shape", tree.shape(i), 0, y[i]


class Model:
    """Potentials from counts {(kind, key, parent label, label): n}."""

    def __init__(self, counts: dict):
        both = {}
        for (kind, key, p, y), n in counts.items():
            both.setdefault((kind, key), {})[p, y] = n
        self.totals = [max(1, sum(n for (k, _, _, y), n in counts.items() if k == "tag" and y == label)) for label in (0, 1)]
        pairs = {(p, y): sum(n for (k, _, a, b), n in counts.items() if k == "tag" and (a, b) == (p, y)) for p in (0, 1) for y in (0, 1)}
        self.any = self._chances({k: n / max(1, sum(pairs.values())) * 4 for k, n in pairs.items()}, (0.5, 0.5))
        self.tags = {key: self._chances(v, self.any) for (kind, key), v in both.items() if kind == "tag"}
        self.words = {key: self._ratio(v, 0.01) for (kind, key), v in both.items() if kind == "word"}
        self.shapes = {key: self._ratio(v, 1.0) for (kind, key), v in both.items() if kind == "shape"}
        for kind in (".", "-", ".a", "-a"):  # a length that no labelled page has tells as much as the shorter ones do
            for size in range(1, 7):
                self.shapes.setdefault(f"{size}{kind}", max(self.shapes.get(f"{k}{kind}", 0.0) for k in range(size)))

    @staticmethod
    def _chances(n: dict, prior) -> tuple[float, float]:
        """P(content | parent's label 0), P(content | 1), with three nodes' worth of the prior."""
        return tuple((n.get((p, 1), 0) + 3 * prior[p]) / (n.get((p, 0), 0) + n.get((p, 1), 0) + 3) for p in (0, 1))

    def _ratio(self, n: dict, smooth: float) -> float:
        return math.log((n.get((0, 1), 0) + smooth) / self.totals[1]) - math.log((n.get((0, 0), 0) + smooth) / self.totals[0])

    def marginals(self, tree: Tree) -> list[float]:
        """Log-odds of being content of every node, by messages up and down the tree."""
        n = len(tree.tag)
        texts = [i for i in range(1, n) if tree.tag[i] == "#text" and tree.text[i].strip()]
        # the texts of a page count as evidence like three texts at most, so that many
        # paragraphs do not outvote what holds them
        weight = 3 / max(3, len(texts))
        own = [0.0] * n
        for i in range(1, n):
            if tree.attrs[i]:
                own[i] = sum(self.words.get(w, 0.0) for w in tree.words(i))
        for i in texts:
            own[i] = weight * self.shapes.get(tree.shape(i), 0.0)
        chance = [self.tags.get(t, self.any) for t in tree.tag]
        up, total = [0.0] * n, own
        for i in range(n - 1, 0, -1):
            c0, c1 = chance[i]
            x = math.exp(max(-50.0, min(50.0, total[i])))
            up[i] = math.log((1 - c1 + c1 * x) / (1 - c0 + c0 * x))
            total[tree.parent[i]] += up[i]
        total[0] = -50.0  # what holds the page is not content
        for i in range(1, n):
            c0, c1 = chance[i]
            q = math.exp(max(-50.0, min(50.0, total[tree.parent[i]] - up[i])))
            total[i] += math.log((c0 + c1 * q) / (1 - c0 + (1 - c1) * q))
        return total

    def extract(self, page: str | None) -> str:
        """The main text: kept texts, white space as one space, one line per block."""
        if not page:
            return ""
        tree = Tree(page)
        odds = self.marginals(tree)
        blocks: dict[int, list[str]] = {}
        for i, t in enumerate(tree.tag):
            if t == "#text" and odds[i] > 0:
                blocks.setdefault(tree.block[i], []).append(tree.text[i])
            elif t == "br":  # parts words wherever it stands in its block
                blocks.setdefault(tree.block[i], []).append(" ")
        lines = (" ".join("".join(parts).split()) for parts in blocks.values())
        return "\n".join(x for x in lines if x)


def train(pages: DataFrame, html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> Model:
    """Count the potentials over the marked pages and about ``sample_pages`` pages of the table.

    The sample is drawn by a hash of the page; Spark sums the counts; the driver gets one row per
    tag, word and shape of the sample.
    """
    spark = pages.sparkSession
    n = pages.count()
    rows = pages.select(whole_text(pages[html_col]).alias("html"))
    share = min(1.0, sample_pages / max(1, n))
    sample = rows.where(F.pmod(F.xxhash64("html"), F.lit(1 << 20)) < share * (1 << 20))
    marked = spark.createDataFrame([(x,) for x in marked_pages()], "html string")

    def count(batches):
        import pyarrow as pa
        from collections import Counter
        found = Counter()
        for b in batches:
            for page in b.column(0).to_pylist():
                found.update(count_page(page))
        keys = list(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.int32()),
             pa.array([k[3] for k in keys], pa.int32()), pa.array([found[k] for k in keys], pa.int64())], names=["kind", "key", "p", "y", "n"])

    schema = "kind string, key string, p int, y int, n long"
    sums = sample.union(marked).mapInArrow(count, schema).groupBy("kind", "key", "p", "y").agg(F.sum("n").alias("n")).collect()
    return Model({(r["kind"], r["key"], r["p"], r["y"]): r["n"] for r in sums})


def extract_text(pages: DataFrame, html_col: str = "html", carry=("page_id", "url"), model: Model | None = None,
                 sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """(carry..., text): the main text of every whole page, one row per row, in one narrow stage.

    Null and empty pages, and pages without content, give an empty text. Repeated rows are each
    returned; extra columns are left out unless carried. Empty table: no rows.
    """
    model = model or train(pages, html_col, sample_pages)
    shared = pages.sparkSession.sparkContext.broadcast(
        {"any": model.any, "tags": model.tags, "words": model.words, "shapes": model.shapes})  # as large as the sample's vocabulary

    def run(batches):
        import pyarrow as pa
        own = Model({})
        own.__dict__.update(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [own.extract(x) for x in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=[*names, "text"])

    names = [f"c{k}" for k in range(len(carry))]
    given = pages.select(*[pages[c].alias(x) for c, x in zip(carry, names)], pages[html_col].alias("html"))
    schema = T.StructType([*[T.StructField(x, given.schema[x].dataType) for x in names], T.StructField("text", T.StringType())])
    return given.mapInArrow(run, schema).toDF(*carry, "text")
