"""Pages to learn from: texts of the corpus set in many made-up layouts, with a label for every block."""

from __future__ import annotations

import numpy as np

# What parts of pages are called in class and id attributes, and short texts that sites put around articles.
BODY = "content post entry article story body text main page blog news detail prose markdown copy rich".split()
WRAP = "container wrapper row col inner site page outer grid section block layout holder box area clearfix md fluid".split()
PARTS = {
    "header": "header masthead top logo brand site-header hero topbar".split(),
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs links main-menu topnav tabs toc".split(),
    "notice": "cookie consent gdpr notice alert banner privacy cookie-notice message popup modal overlay paywall toast".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo banner-ad adsense commercial ad-slot promotion".split(),
    "side": "sidebar side aside rail widget secondary related recommended popular trending most-read more recirc".split(),
    "share": "share social sharing follow tools share-bar social-links tags meta-tags".split(),
    "form": "form newsletter subscribe signup search login search-form contact register".split(),
    "comments": "comments comment-list discussion replies responses comment-section disqus reader-comments feedback thread".split(),
    "footer": "footer bottom colophon copyright site-footer legal imprint foot".split(),
}
SHORT = {
    "header": ("Daily News", "The Gazette", "Your source for news", "Welcome", "My site", "Nachrichten", "Le journal", "Noticias de hoy"),
    "nav": ("Home", "About us", "Contact", "News", "Sports", "Politics", "Log in", "Sign up", "Archive", "Startseite", "Accueil", "Inicio", "Kontakt", "Search", "Help", "FAQ", "Products", "Skip to content", "Next page", "Previous"),
    "notice": (
        "We use cookies to improve your experience.", "By using this site you accept our cookies.", "Accept all cookies", "This site uses cookies.", "You have 3 free articles left this month.", "Please enable JavaScript.",
        "Wir verwenden Cookies.", "Ce site utilise des cookies.", "Este sitio utiliza cookies.", "Your session has expired.", "Maintenance tonight.", "Accept", "Reject", "Close", "Important notice",
    ),
    "ad": ("Advertisement", "Sponsored", "Buy now and save 50%!", "Limited offer", "Anzeige", "Publicité", "Publicidad", "Shop now", "Ad", "Promoted content"),
    "side": ("Related articles", "Most read", "Popular posts", "You may also like", "Recent posts", "Trending", "Categories", "Archives", "Read next", "Mehr zum Thema", "À lire aussi", "Lo más leído"),
    "share": ("Share", "Tweet", "Share on Facebook", "Email", "Print", "Copy link", "Follow us", "Teilen", "Partager", "Compartir", "Tags:"),
    "form": ("Email address", "Subscribe", "Your name", "Sign up for our newsletter", "Send", "Password", "Search", "Submit", "Message", "Log in", "Abonnieren", "S'abonner", "Suscribirse", "Leave a comment", "Remember me"),
    "comments": ("Comments", "3 comments", "Leave a reply", "Reply", "Report", "Anonymous says:", "Kommentare", "Commentaires", "Comentarios", "2 days ago", "Like", "Great article!", "Thanks for sharing.", "I disagree.", "First!"),
    "footer": ("© 2024 All rights reserved.", "Terms of use", "Privacy policy", "Copyright", "Imprint", "Impressum", "Mentions légales", "Aviso legal", "Contact us", "Powered by", "Back to top", "Sitemap"),
}
_SOUNDS = "a e i o u an er in ou re st th ng el on ti ar ch mi po la".split()


class Layout:
    """One page: ``html`` and ``labels`` of its blocks, in their order; 1 for the article's."""

    def __init__(self, r: np.random.Generator, main: list[str], other: list[str]):
        self.r, self.main, self.other = r, main, other
        self.out: list[str] = []
        self.labels: list[int] = []

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def one(self, values):
        return values[int(self.r.integers(len(values)))]

    def invented(self, most: int) -> str:
        words = ["".join(self.one(_SOUNDS) for _ in range(self.r.integers(1, 4))) for _ in range(self.r.integers(1, most))]
        return " ".join(words).capitalize() + self.one((".", ".", ".", "", "!", "?"))

    def prose(self, most: int = 80) -> str:
        """A paragraph, from one word up: the corpus's, invented, or rarely one that is usual around articles."""
        if self.chance(0.05):
            return self.one(SHORT[self.one(list(SHORT))])
        if self.chance(0.05):
            return self.invented(5).upper() + self.one(("", "!", "!!"))
        if self.main and self.chance(0.7):
            words = self.one(self.other if self.other and self.chance(0.2) else self.main).split()
            n = int(self.r.integers(1, most)) if self.chance(0.7) else int(self.r.integers(1, 6))
            at = int(self.r.integers(0, max(1, len(words) - n + 1)))
            return " ".join(words[at : at + n])
        return self.invented(most if self.chance(0.7) else 5)

    def attributes(self, kind: list[str] | None) -> str:
        found = [self.one(kind)] if kind else []
        if self.chance(0.25):
            found.append(self.one(WRAP))
        if self.chance(0.15):
            found.append("".join(self.one(_SOUNDS) for _ in range(3)))
        if not found:
            return ""
        self.r.shuffle(found)
        return f' id="{found[0]}"' if self.chance(0.25) else f' class="{" ".join(found)}"'

    def leaf(self, tag: str, text: str, label: int, attributes: str = "") -> None:
        shown = text.replace("&", "&amp;").replace("<", "&lt;")
        if not shown.strip():
            shown = "x"
        if label and self.chance(0.12):
            words = shown.split()
            k = int(self.r.integers(len(words)))
            words[k] = f"<{(i := self.one(('b', 'i', 'em', 'strong', 'span', 'a href=/x')))}>{words[k]}</{i.split()[0]}>"
            shown = " ".join(words)
        if label and tag == "p" and self.chance(0.05):
            shown = f"<b>{shown}<br>"
        self.out.append(f"<{tag}{attributes}>{shown}" + ("" if tag in ("p", "li") and self.chance(0.1) else f"</{tag}>"))
        self.labels.append(label)

    def part(self, kind: str, tag: str | None = None) -> None:
        """A part of the page that is not the article; most are named by tag, class or id."""
        r, texts = self.r, SHORT[kind]
        own = {"header": "header", "nav": "nav", "footer": "footer", "side": "aside", "form": "form", "comments": "section"}.get(kind)
        tag = tag or (own if own and (kind in ("form", "nav") or self.chance(0.6)) else self.one(("div", "div", "section", "ul" if kind == "nav" else "div")))
        named = tag == own and kind not in ("comments",) and self.chance(0.5)
        around = self.chance(0.3)
        if around:
            self.out.append(f"<div{self.attributes(None)}>")
        if tag == "div" and kind in ("ad", "notice", "share") and self.chance(0.5):  # one block, nothing inside
            text = self.one(texts) if self.chance(0.4) else self.one(self.other) if self.other and self.chance(0.5) else self.prose(30)
            self.leaf(self.one(("div", "p", "span", "section")) if around else self.one(("div", "p")), text, 0, self.attributes(PARTS[kind]))
        else:
            self.out.append(f"<{tag}{'' if named else self.attributes(PARTS[kind])}>")
            if kind == "nav" or kind in ("side", "footer", "share", "header") and self.chance(0.4):
                if kind == "side":
                    self.leaf(self.one(("h2", "h3", "h4", "p")), self.one(texts), 0)
                lists = tag != "ul" and self.chance(0.7)
                self.out.append("<ul>" if lists else "")
                for _ in range(r.integers(2, 9)):
                    link = self.one(texts) if self.chance(0.5) else self.one(self.other) if self.other and self.chance(0.6) else self.invented(8 if kind == "side" else 3)
                    if lists or tag == "ul":
                        self.out.append("<li><a href='/x'>" + link.replace("&", "&amp;").replace("<", "&lt;") + "</a></li>")
                    else:
                        self.out.append("<div><a href='/x'>" + link.replace("&", "&amp;").replace("<", "&lt;") + "</a></div>")
                    self.labels.append(0)
                self.out.append("</ul>" if lists else "")
            elif kind == "comments":
                self.leaf(self.one(("h2", "h3", "p")), self.one(texts), 0)
                for _ in range(r.integers(1, 5)):
                    self.out.append(self.one(("<div class=comment>", "<li>", "<article class=comment>", "<div>")))
                    if self.chance(0.6):
                        self.leaf(self.one(("cite", "h4", "p", "div")), self.invented(3), 0, " class=author" if self.chance(0.5) else "")
                        self.out.append("<p>" if self.out[-1].endswith("</cite>") else "")
                    for _ in range(r.integers(1, 3)):
                        self.leaf("p", self.prose(50), 0)
                    if self.chance(0.4):
                        self.leaf("p", self.one(texts), 0)
                    self.out.append(self._ends(self.out))
            elif kind == "form":
                for _ in range(r.integers(1, 4)):
                    self.leaf(self.one(("p", "div", "li")), self.one(texts), 0)
                    self.out.append("<input name=q>")
            else:
                for _ in range(r.integers(1, 4)):
                    text = self.one(texts) if self.chance(0.5) else self.one(self.other) if self.other and self.chance(0.4) else self.prose(30)
                    self.leaf(self.one(("p", "div", "h3", "p")), text, 0)
            self.out.append(f"</{tag}>")
        if around:
            self.out.append("</div>")

    @staticmethod
    def _ends(out: list[str]) -> str:
        for x in reversed(out):
            for tag in ("div class=comment", "li", "article class=comment", "div"):
                if x == f"<{tag}>":
                    return f"</{tag.split()[0]}>"
        return ""

    def article(self) -> None:
        r = self.r
        kind = int(r.integers(6))
        tag = ("article", "main", "article", "div", "section", "div")[kind]
        nested = self.chance(0.3)
        if nested:
            self.out.append(self.one((f"<main{self.attributes(None)}>", f"<div{self.attributes(BODY)}>", "<article>", "<div>")))
        self.out.append(f"<{tag}{self.attributes(BODY) if kind > 2 and (kind < 5 or not nested) or self.chance(0.3) else ''}>")
        if self.chance(0.85):
            self.leaf(self.one(("h1", "h1", "h2")), self.prose(14), 1)
        for _ in range(r.integers(1, 22)):
            x = r.random()
            if x < 0.7:
                self.leaf("p", self.prose(120), 1, self.attributes(None) if self.chance(0.05) else "")
            elif x < 0.76:
                self.leaf(self.one(("h2", "h3", "h4")), self.prose(8), 1)
            elif x < 0.81:
                self.out.append(f"<{(t := self.one(('ul', 'ol')))}>")
                for _ in range(r.integers(1, 6)):
                    self.leaf("li", self.prose(20), 1)
                self.out.append(f"</{t}>")
            elif x < 0.84:
                self.out.append("<blockquote>")
                self.leaf("p", self.prose(40), 1)
                self.out.append("</blockquote>")
            elif x < 0.86:
                self.out.append("<figure><img src=x>")
                self.leaf("figcaption", self.prose(15), 1)
                self.out.append("</figure>")
            elif x < 0.88:
                self.out.append("<table><tr>")
                for _ in range(r.integers(1, 5)):
                    self.leaf("td", self.prose(6), 1)
                self.out.append("</tr></table>")
            elif x < 0.9:
                self.leaf("pre", self.prose(30), 1)
            elif x < 0.93:
                self.leaf("div", self.prose(90), 1)
            else:
                self.part(self.one(("ad", "share", "side", "notice", "form", "ad")))
        if self.chance(0.2):
            self.part(self.one(("share", "side", "form")))
        if self.chance(0.2):
            self.part("comments")
        self.out.append(f"</{tag}>" + ("</main></div></article>" if nested else ""))

    def whole(self) -> tuple[str, list[int]]:
        self.out.append("<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>" + ("<div id=page class=wrapper>" if self.chance(0.3) else ""))
        for kind, p in (("notice", 0.25), ("header", 0.5), ("nav", 0.8), ("ad", 0.4), ("notice", 0.15), ("nav", 0.2), ("side", 0.25), ("form", 0.15)):
            if self.chance(p):
                self.part(kind)
        if self.chance(0.95):
            self.article()
        for kind, p in (("share", 0.2), ("ad", 0.25), ("side", 0.4), ("comments", 0.35), ("form", 0.25), ("notice", 0.1), ("footer", 0.85)):
            if self.chance(p):
                self.part(kind)
        self.out.append("</body></html>")
        return "".join(self.out), self.labels


def layouts(n: int, main: list[str], other: list[str], seed: int = 3) -> list[tuple[str, list[int]]]:
    """``n`` pages with their labels. ``main`` and ``other``: texts of articles and of what is around them; either may be empty."""
    r = np.random.default_rng(seed)
    return [Layout(r, main, other).whole() for _ in range(n)]
