"""Classifiers as ordered conditional expressions over word lists, which are data: pass other lists to extend them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import url as U

# Hosts and brands that are never a business's own site.
NOISE_BRANDS = "facebook instagram twitter x linkedin youtube tiktok pinterest reddit threads snapchat wikipedia wikivoyage quora wordpress blogspot blogger medium substack tumblr wix weebly squarespace google apple microsoft whatsapp telegram linktree tinyurl indeed glassdoor foodpanda grubhub ubereats deliveroo doordash".split()
# Directories of many businesses by brand, with how far they are trusted.
DIRECTORIES = {
    "high": ("marinas", "navily", "harbourmaps"),
    "medium": (
        "yellowpages", "yelp", "tripadvisor", "clutch", "foursquare", "mapquest", "manta", "hotfrog", "bbb", "crunchbase", "trustpilot", "justdial", "healthgrades", "zocdoc", "opencare",
        "citysearch", "opentable", "zomato", "thefork", "resy", "squaremeal", "restaurantguru", "sirved", "menupix", "wanderlog", "allmenus", "timeout", "eater",
    ),
    "low": ("cylex", "brownbook", "n49", "cybo", "citypass", "sulekha", "sitejabber", "vitals", "ratemds", "hotels"),
}
NOISE_HOSTS = "wa.me t.me bit.ly linktr.ee apps.apple.com itunes.apple.com play.google.com m.me api.whatsapp.com goo.gl maps.app.goo.gl".split()
NOISE_PATHS = "/news/ /press/ /press-release/ /press-releases/ /forum/ /forums/ /thread/ /threads/ /wiki/ .pdf".split()
LISTICLE_PATHS = "/blog /article /articles /guide /guides /region/ /browse/ /explore /category/ /list /directory /directories".split()
LISTICLE_TITLE = r"(?i)(^|[^a-z0-9_])([0-9]+ +best|best +[0-9]+|top +[0-9]+|the +best|best|top|most +popular|a +guide|guide +to|near +me|where +to|must[- ]?visit|reviews?|ranked|listings?|directory)([^a-z0-9_]|$)"
# First host labels and path parts of sign-in, help and shop pages.
UTILITY_LABELS = "help support signup sign-up login signin account accounts blog shop store app apps api docs status mail satellite cdn static ads ad portal my dashboard go get link track".split()
UTILITY_PATHS = "/signup /sign-up /signin /login /register /account /support /help /privacy /terms /cart /checkout /subscribe /download /advertise".split()
# Path and title tokens by how much a page tells about a business.
IGNORED = "privacy privacy-policy cookie cookies cookie-policy terms tos terms-of-service terms-and-conditions login signin sign-in logout signout register signup sign-up search cart checkout sitemap 404 500 error not-found".split()
HIGH = "products product services service solutions solution capabilities capability industries industry manufacturing engineering equipment technologies technology portfolio projects project case-studies case-study casestudy about company overview our-company business-units business-unit divisions division markets markets-served expertise what-we-do whatwedo".split()
MEDIUM = "leadership team management certifications certification iso sustainability innovation locations location".split()
LOW = "careers career jobs job news blog events event press press-releases press-release investors investor-relations faq faqs".split()
TIER_SCORES = {"high": 30, "medium": 15, "low": 5, "unknown": 10}
# Page classes by path token, in order of precedence.
PAGE_TYPES = (("about", "about company overview"), ("services", "services service solutions"), ("products", "products product"), ("contact", "contact contacts"), ("blog", "blog blogs news insights articles article press"), ("careers", "careers career jobs"), ("legal", "privacy terms cookies legal imprint impressum"))
# Crawl priority by token, first match wins.
FALLBACK_SCORES = ((95, "about company overview"), (95, "services solutions"), (90, "products"), (85, "contact"), (85, "projects portfolio case-studies case-study"), (80, "industries capabilities expertise"), (75, "portal customer-portal dashboard account"), (70, "login signin sign-in"), (20, "blog news"), (10, "careers career jobs"), (5, "gallery"), (0, "privacy terms cookies cookie-policy"))


def _any_in(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def overlaps(tokens: Column, words: list[str]) -> Column:
    return F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))


def is_utility(url: Column) -> Column:
    """By the first host label, as long as there is a dot, or by a path part."""
    labels = F.split(U.host(url), r"\.")
    return ((F.size(labels) > 1) & labels[0].isin(*UTILITY_LABELS)) | _any_in(F.lower(U.path(url)), UTILITY_PATHS)


def brand(url: Column) -> Column:
    return F.split(U.registered_domain(url), r"\.")[0]


def classify_result(url: Column, title: Column, directories: dict[str, tuple] = DIRECTORIES) -> Column:
    """official, discovery_source or noise: no host, noise host, noise brand, known directory, noise path, listicle."""
    h, p = U.host(url), F.lower(U.path(url))
    noise_host = h.isin(*NOISE_HOSTS)
    for d in NOISE_HOSTS:
        noise_host = noise_host | h.endswith("." + d)
    return (
        F.when((h == "") | noise_host | brand(url).isin(*NOISE_BRANDS), "noise")
        .when(brand(url).isin(*[b for some in directories.values() for b in some]), "discovery_source")
        .when(_any_in(p, NOISE_PATHS), "noise")
        .when(_any_in(p, LISTICLE_PATHS) | F.coalesce(title, F.lit("")).rlike(LISTICLE_TITLE), "discovery_source")
        .otherwise("official")
    )


def source_confidence(url: Column, directories: dict[str, tuple] = DIRECTORIES) -> Column:
    """high, medium or low for a known directory, low for other discovery sources; null for what is none."""
    out = F.when(classify_result(url, F.lit(""), directories) != "discovery_source", F.lit(None).cast("string"))
    for level, brands in directories.items():
        out = out.when(brand(url).isin(*brands), level)
    return out.otherwise("low")


# Path segments of pages that name contacts, in several languages.
CONTACT_HINTS = (
    "contact", "contact-us", "contactus", "reach-us", "get-in-touch", "about", "about-us", "aboutus", "team", "staff", "people", "hello", "connect", "enquiry", "enquiries", "imprint", "legal",
    "impressum", "kontakt", "ueber-uns", "uber-uns", "contactez-nous", "nous-contacter", "mentions-legales", "a-propos", "contatti", "chi-siamo", "contacto", "contactanos", "contato",
    "quienes-somos", "sobre-nosotros",
)


def contact_priority(url: Column) -> Column:
    """0 for contact pages, 1 for pages with such a word in their path, 2 for others: the order in which to visit."""
    path = F.regexp_replace(F.lower(U.path(url)), "^/+|/+$", "")
    last = F.element_at(F.split(path, "/"), -1)
    return F.when(last.isin(*CONTACT_HINTS) | path.isin(*CONTACT_HINTS), 0).when(_any_in(path, CONTACT_HINTS), 1).otherwise(2)


# What cookie panels say.
CONSENT = (
    "necessary cookies", "functional cookies", "analytical cookies", "advertisement cookies", "performance cookies", "targeting cookies", "strictly necessary cookies", "accept all cookies", "reject all",
    "manage cookie preferences", "cookie preference", "consent preference", "cookie policy", "cookie settings", "collecting feedback, and enabling third-party tools", "track visitor interactions",
    "personalized ads based on your previous visits",
)


def without_consent(text: Column) -> Column:
    """A text without the lines of cookie panels; the word cookie alone is no reason."""
    heading = r"(?i)^(necessary|functional|analytical|advertisement|performance|targeting|marketing|strictly necessary)\s+cookies$"
    return F.array_join(F.filter(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), lambda x: ~F.trim(x).rlike(heading) & ~_any_in(F.lower(x), CONSENT)), "\n")


def page_type(url: Column) -> Column:
    """Class of a page by its path; a page below a blog's index is a blog post."""
    tokens = U.path_tokens(url)
    out = F.when(F.size(U.segments(url)) == 0, "home")
    for name, words in PAGE_TYPES:
        hit = overlaps(tokens, words.split())
        if name == "blog":
            segs = F.transform(U.segments(url), lambda s: F.lower(s))
            post = F.exists(F.slice(segs, 1, F.greatest(F.size(segs) - 1, F.lit(0))), lambda s: s.isin(*words.split()))  # noqa: B023
            out = out.when(hit & post, "blog_post").when(hit, "blog")
        else:
            out = out.when(hit, name)
    return out.otherwise("other")


def tier(url: Column, kind: Column) -> Column:
    """high, medium, low or unknown; null for a page to ignore."""
    t = U.path_tokens(url)
    return (
        F.when(overlaps(t, IGNORED), F.lit(None).cast("string")).when(overlaps(t, HIGH), "high").when(overlaps(t, MEDIUM), "medium").when(overlaps(t, LOW), "low")
        .when(kind.isin("home", "about", "services", "products"), "high").when(kind.isin("blog", "legal"), "low").otherwise("unknown")
    )


def fallback_score(url: Column) -> Column:
    out = F.when(F.size(U.segments(url)) == 0, 100)
    for score, words in FALLBACK_SCORES:
        out = out.when(overlaps(U.path_tokens(url), words.split()), score)
    return out.otherwise(40)


def sufficiency(html: Column, visible: Column, least: int = 400, ratio: float = 0.02) -> Column:
    """Why a fetched page has too little text, or "ok"."""
    n = F.length(visible)
    shell = F.lower(html).rlike(r"""id=["'](root|app|__next|__nuxt)["']""")
    return (
        F.when(F.coalesce(html, F.lit("")) == "", "empty_response").when(shell & (n < 2 * least), "spa_shell_marker").when(n < least, "below_min_chars")
        .when((n < 4 * least) & (n / F.length(html) < ratio), "low_text_ratio").otherwise("ok")
    )
