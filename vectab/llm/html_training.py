"""Made-up labelled pages: the labeller learns layouts from them, not from any site."""

from __future__ import annotations

import random
from collections.abc import Callable

KEEP = "\ue000"  # marks words of the article; taken out again before a block is read

# words and names that pages of many sites share, in the four languages: fixed values
MENU_WORDS = (
    "Home About Contact Products News Blog Sports Login Archive Shop Help Startseite Kontakt Impressum Produkte Anmelden"
    " Accueil Produits Actualités Connexion Boutique Aide Inicio Contacto Productos Noticias Tienda Ayuda").split()
NOTICES = (
    "We use cookies to improve your experience", "Accept all cookies", "Subscribe to our newsletter", "Please enable JavaScript",
    "Sign up for free to continue reading", "You have reached your limit of free articles", "Wir verwenden Cookies",
    "Alle Cookies akzeptieren", "Newsletter abonnieren", "Nous utilisons des cookies", "Accepter les cookies",
    "Abonnez-vous à notre lettre", "Usamos cookies para mejorar", "Aceptar cookies", "Suscríbete al boletín")
FOOTS = (
    "All rights reserved", "Copyright", "Privacy policy", "Terms of use", "Powered by", "Alle Rechte vorbehalten", "Datenschutz",
    "Tous droits réservés", "Mentions légales", "Todos los derechos reservados", "Aviso legal", "© 2021", "© 2024")
ADVERTS = ("Advertisement", "Sponsored", "Anzeige", "Publicité", "Publicidad", "Buy now", "Special offer", "Promoted")
SHARES = ("Share", "Tweet", "Like", "Follow us", "Print", "Teilen", "Partager", "Compartir", "Facebook", "E-mail")
TALKS = ("Comments", "Reply", "Leave a comment", "Kommentare", "Antworten", "Commentaires", "Répondre", "Comentarios", "Responder")
ASIDES = ("Related", "Most read", "Popular posts", "More stories", "Recommended", "Meistgelesen", "À lire aussi", "Lo más leído", "Tags")
LABELS = ("Name", "E-mail", "Password", "Search", "Message", "Send", "Passwort", "Suche", "Nom", "Recherche", "Nombre", "Buscar")
NAMES = {
    "menu": "nav menu navbar navigation main-menu topnav breadcrumb breadcrumbs pagination tabs pager toc",
    "head": "header masthead site-header topbar branding logo page-header",
    "foot": "footer site-footer bottom colophon copyright legal page-footer",
    "side": "sidebar side aside widget rail related recommended popular trending more-stories teaser sidebar-right",
    "note": "cookie consent notice alert gdpr cookie-banner popup modal overlay newsletter subscribe paywall message",
    "ad": "ad ads advert advertisement sponsored promo banner adsense sponsor ad-box advertising",
    "form": "form login signup search contact-form search-form subscribe-form",
    "talk": "comments comment-list comment discussion replies respond user-comments reader-comments",
    "share": "share social sharing share-buttons follow social-links",
    "main": "content main article post entry story text article-body post-content entry-content main-content page-content",
}
TAGS = {
    "menu": "nav div ul div", "head": "header div header", "foot": "footer div footer", "side": "aside div section aside",
    "note": "div section div", "ad": "div aside section", "form": "form div form", "talk": "section div div", "share": "div ul div",
    "main": "article main div section article",
}
PLAIN = "row col wrap inner box container block unit".split()
COMMON = "the of and to in is that der die und in zu den le la de et les des el la que y los en".split()
PARTS = (
    "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve sch ung heit lich ein ver be ge"
    " ent eau eux aux ment tion que elle ou ai ción mente ado ía os as illo ñ é è ü ä ß").split()


class Page:
    """Writes one page; words of the article carry ``KEEP``."""

    def __init__(self, rng: random.Random):
        self.rng = rng
        parts, common = rng.sample(PARTS, 24), rng.sample(COMMON, 8)
        self.words = ["".join(rng.choices(parts, k=rng.randint(1, 5))) for _ in range(120)] + 8 * common
        self.noise = rng.choice(["", "", "", " ###", "*** ", " &amp;&amp;&amp;", " |", " |", "!!!", " 12", " =", "_x"])
        self.classes = rng.random()  # share of elements with telling names, low on some pages
        self.semantic = rng.random() < 0.7
        self.ends = rng.random() < 0.8  # end tags of paragraphs and items are written

    def some(self, p: float) -> bool:
        return self.rng.random() < p

    def word(self) -> str:
        return self.rng.choice(self.words)

    def sentence(self, low: int = 1, high: int = 18) -> str:
        words = self.rng.choices(self.words, k=self.rng.randint(low, high))
        if self.noise:
            words = [w + self.noise if self.some(0.4) else w for w in words]
        return (" ".join(words)).capitalize() + "."

    def prose(self, most: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(1, most)))

    def name(self, role: str) -> str:
        rng = self.rng
        tag = rng.choice(TAGS[role].split()) if self.semantic else "div"
        if tag in ("div", "section", "ul") or self.some(0.4):
            words = rng.choice(NAMES[role].split()) if self.some(0.5 + self.classes / 2) else rng.choice(PLAIN)
            if self.some(0.2):
                words = f"{words} {rng.choice(PLAIN)}" if self.some(0.5) else words.replace("-", "_").title()
            kind = "id" if self.some(0.25) else "class"
            return f'{tag} {kind}="{words}"' if self.some(0.9) else f"{tag} {kind}={words.split()[0]}"
        return tag

    def element(self, role: str, *inner: str) -> str:
        name = self.name(role)
        return f"<{name}>{''.join(inner)}</{name.split()[0]}>"

    def p(self, text: str, tag: str = "p") -> str:
        return f"<{tag}>{text}</{tag}>" if self.ends or tag not in ("p", "li", "dd", "td") else f"<{tag}>{text}"

    def link(self, text: str) -> str:
        return f'<a href="/{self.rng.randint(0, 999)}">{text}</a>'

    def links(self, words: Callable[[], str], most: int = 8) -> str:
        items = [self.link(words()) for _ in range(self.rng.randint(1, most))]
        if self.some(0.7):
            return f"<ul>{''.join(self.p(i, 'li') for i in items)}</ul>"
        return self.rng.choice([" | ", " ", "\n", " &middot; "]).join(items)

    # --- what is not the article ---

    def menu(self) -> str:
        return self.element("menu", self.links(lambda: self.rng.choice(MENU_WORDS) if self.some(0.4) else self.sentence(1, 2).strip(".")))

    def head(self) -> str:
        inner = [self.p(self.sentence(1, 4), self.rng.choice(["h1", "h2", "div", "p", "span"]))]
        if self.some(0.4):
            inner.append(self.p(self.sentence(), self.rng.choice(["p", "div"])))
        if self.some(0.4):
            inner.append(self.links(lambda: self.rng.choice(MENU_WORDS)))
        return self.element("head", *inner)

    def foot(self) -> str:
        inner = []
        if self.some(0.6):
            inner.append(f"{self.rng.choice(['&copy;', '&#169;', '©'])} {self.word()}.example.com {self.rng.choice(['&middot;', '-', '|'])} {self.prose(3)}")
        if self.some(0.5):
            inner.append(self.p(f"{self.rng.choice(FOOTS)} {self.sentence(1, 6) if self.some(0.5) else ''}"))
        if self.some(0.4) or not inner:
            inner.append(self.links(lambda: self.rng.choice(FOOTS) if self.some(0.5) else self.sentence(1, 2)))
        return self.element("foot", *inner)

    def side(self) -> str:
        inner = [self.p(self.rng.choice(ASIDES) if self.some(0.6) else self.sentence(1, 3), self.rng.choice(["h2", "h3", "h4", "div"]))]
        for _ in range(self.rng.randint(1, 3)):
            inner.append(self.links(lambda: self.sentence(1, 8), 5) if self.some(0.5) else self.p(self.prose(2)))
        return self.element("side", *inner)

    def note(self) -> str:
        text = f"{self.rng.choice(NOTICES) if self.some(0.7) else ''} {self.prose(2) if self.some(0.6) else ''}" or self.sentence()
        button = self.p(self.rng.choice(["OK", "Accept", "Akzeptieren", "Accepter", "Aceptar", "Close"]), "button") if self.some(0.4) else ""
        return self.element("note", self.p(text, self.rng.choice(["p", "div", "span"])), button)

    def ad(self) -> str:
        text = f"{self.rng.choice(ADVERTS) if self.some(0.4) else ''} {self.prose(2)}"
        text = self.link(text) if self.some(0.3) else text
        return self.element("ad", text if self.some(0.6) else self.p(text))

    def form(self) -> str:
        inner = [f"<label>{self.rng.choice(LABELS)}</label><input name=x>" for _ in range(self.rng.randint(1, 3))]
        if self.some(0.4):
            inner.insert(0, self.p(self.sentence()))
        if self.some(0.3):
            inner.append(f"<select><option>{self.word()}<option>{self.word()}</select><textarea>{self.word()}</textarea>")
        return self.element("form", "<form>" if self.some(0.7) else "", *inner, f"<button>{self.rng.choice(LABELS)}</button>")

    def talk(self) -> str:
        inner = [self.p(f"{self.rng.choice(TALKS) if self.some(0.7) else self.sentence(1, 2)} ({self.rng.randint(1, 40)})", self.rng.choice(["h2", "h3", "div"]))]
        for _ in range(self.rng.randint(1, 5)):
            who = self.p(self.sentence(1, 2).strip("."), self.rng.choice(["b", "span", "div", "cite", "strong"]))
            when = f"<span>{self.rng.randint(1, 28)}.{self.rng.randint(1, 12)}.2023</span>" if self.some(0.3) else ""
            back = self.link(self.rng.choice(TALKS)) if self.some(0.3) else ""
            one = f"{who} {when}{self.p(self.prose(3))}{back}"
            inner.append(self.element("talk", one) if self.some(0.5) else self.p(one, self.rng.choice(["div", "li"])))
        return self.element("talk", *inner)

    def share(self) -> str:
        return self.element("share", self.links(lambda: self.rng.choice(SHARES), 5))

    # --- the article ---

    def kept(self, text: str) -> str:
        return " ".join(KEEP + w for w in text.split())

    def passage(self) -> str:
        rng, kind = self.rng, self.rng.random()
        text = self.kept(self.prose(rng.choice([1, 3, 6, 12])))
        if self.some(0.2):  # short, odd or much like what stands around articles: the place decides
            text = self.kept(rng.choice([
                self.sentence(1, 3), self.sentence(1, 3), " ".join([self.word()] * rng.randint(2, 30)), self.prose(2).upper(),
                f"{rng.choice(FOOTS + NOTICES + ADVERTS + ASIDES + TALKS)} {self.sentence(1, 4) if self.some(0.5) else ''}",
                f"{self.sentence()} {self.word()}@{self.word()}.example.com +49 {rng.randint(10**6, 10**9)}",
            ]))
        if kind < 0.62:
            if self.some(0.15):
                text = f"{text} {self.link(self.kept(self.sentence(1, 3)))} {self.kept(self.sentence())}"
            if self.some(0.1):
                tag = rng.choice(["b", "em", "i", "strong", "span"])
                text = f"<{tag}>{text}" + (f"</{tag}>" if self.some(0.7) else rng.choice(["", "<br>"]))
            return self.p(text, "p" if self.some(0.9) else "div")
        if kind < 0.72:
            return self.p(self.kept(self.sentence(1, 7).strip(".")), rng.choice(["h2", "h3", "h4"]))
        if kind < 0.80:
            items = "".join(self.p(self.kept(self.sentence(1, 12)), "li") for _ in range(rng.randint(1, 6)))
            return self.p(items, rng.choice(["ul", "ol"]))
        if kind < 0.85:
            return self.p(self.p(text) if self.some(0.5) else text, "blockquote")
        if kind < 0.88:
            return self.p(text, "pre")
        if kind < 0.91:
            rows = "".join(f"<tr>{''.join(self.p(self.kept(self.sentence(1, 3)), 'td') for _ in range(3))}</tr>" for _ in range(rng.randint(1, 4)))
            return f"<table>{rows}</table>"
        if kind < 0.94:
            return f"<figure><img src=x alt='{self.word()}'><figcaption>{self.kept(self.sentence())}</figcaption></figure>"
        return f"{text}<br><br>{self.kept(self.prose(2))}" if self.some(0.5) else f"<div>{text}<br>{self.kept(self.prose(2))}</div>"

    def article(self) -> str:
        rng = self.rng
        inner = []
        if self.some(0.85):
            title = self.p(self.kept(self.sentence(1, 12)), "h1" if self.some(0.8) else "h2")
            inner.append(f"<header>{title}</header>" if self.some(0.1) else title)
        if self.some(0.2):
            inner.append(f"<p><b>{self.kept(self.sentence())}<br>")
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9, 14, 30])):
            inner.append(self.passage())
            if self.some(0.05):
                inner.append(rng.choice([self.ad, self.ad, self.share, self.side, self.note, self.menu])())
        if len(inner) < 2:
            inner.append(self.p(self.kept(self.sentence())))
        if self.some(0.12):
            inner.append(rng.choice([self.share, self.talk, self.side])())
        body = "".join(inner)
        if self.some(0.08):
            return body
        if self.some(0.06):
            return f"<table><tr><td>{body}</td></tr></table>"
        inside = self.element("main", body)
        return f"<div class={rng.choice(PLAIN)}>{inside}</div>" if self.some(0.2) else inside

    def html(self) -> str:
        rng = self.rng
        before = [f for f, p in ((self.note, 0.2), (self.head, 0.45), (self.menu, 0.7), (self.form, 0.15), (self.ad, 0.3), (self.side, 0.12), (self.menu, 0.1)) if self.some(p)]
        after = [f for f, p in ((self.share, 0.2), (self.ad, 0.15), (self.form, 0.12), (self.talk, 0.4), (self.side, 0.35), (self.menu, 0.1), (self.foot, 0.75), (self.note, 0.15)) if self.some(p)]
        if self.some(0.1):
            rng.shuffle(before)
        body = "".join(f() for f in before) + self.article() + "".join(f() for f in after)
        if self.some(0.25):
            body = f"<div {rng.choice(['id', 'class'])}={rng.choice(['page', 'wrapper', 'container', 'site'])}>{body}</div>"
        top = f"<!DOCTYPE html><html><head><title>{self.sentence()}</title><style>p{{}}</style><script>track('<p>')</script></head><body>" if self.some(0.9) else ""
        page = f"{top}{body}</body></html>" if top else body
        if self.some(0.08):
            page = page[: int(len(page) * rng.uniform(0.5, 1))]
        if self.some(0.05):
            page = page.replace("<p>", "<P>").replace("</p>", "</P>").replace("<div", "<DIV").replace("</div", "</DIV")
        return page


def training_pages(n: int, seed: int) -> list[str]:
    """``n`` pages, the same for the same seed."""
    rng = random.Random(seed)
    return [Page(rng).html() for _ in range(n)]
