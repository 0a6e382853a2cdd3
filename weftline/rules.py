"""Site configuration and vendor rules, as immutable values that closures carry to the executors.

`Rules` holds the registries that decide what an attribute or a path means;
vendor profiles add to them by `merged`. A name that two profiles claim with
different values, or a profile that is loaded twice, is an error at start.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

# Extensions that mark an asset; xml is a sitemap, never an asset of a page.
ASSET_EXTENSIONS = tuple(
    "css js mjs map json xml xsl txt png jpg jpeg gif webp avif svg ico bmp woff woff2 ttf otf eot mp4 webm ogv mp3 ogg wav m4a "
    "pdf zip gz doc docx xls xlsx ppt pptx webmanifest wasm".split()
)
MEDIA_EXTENSIONS = tuple("mp4 webm ogv mp3 ogg wav m4a pdf zip gz doc docx xls xlsx ppt pptx wasm".split())
# Paths of dynamic endpoints.
DYNAMIC_PATHS = (
    r"/wp-admin(/|$)", r"/wp-login\.php", r"/wp-json(/|$)", r"/xmlrpc\.php", r"/wp-signup\.php", r"/wp-activate\.php",
    r"/wp-trackback\.php", r"/feed/?$", r"/comments/feed", r"/wp-cron\.php",
)


@dataclass(frozen=True)
class Rules:
    url_attrs: tuple[str, ...] = ("src", "href", "poster")
    page_url_attrs: tuple[str, ...] = ()
    b64_url_attrs: tuple[str, ...] = ()
    srcset_attrs: tuple[str, ...] = ("srcset",)
    css_url_attrs: tuple[str, ...] = ()
    lazy_img_attrs: tuple[str, ...] = ()
    noise_patterns: tuple[tuple[str, str], ...] = ()
    dynamic_paths: tuple[str, ...] = DYNAMIC_PATHS
    skip_prefixes: tuple[str, ...] = ()
    script_ref_dirs: tuple[str, ...] = ("wp-content", "wp-includes")
    skip_ref_prefixes: tuple[str, ...] = ()
    text_attrs: tuple[str, ...] = ("alt", "title", "aria-label", "placeholder")
    beacons: tuple[tuple[str, str, str], ...] = ()
    profiles: tuple[str, ...] = ()

    def merged(self, name: str, **more: tuple) -> Rules:
        """These rules with a profile's registrations appended; unknown registries and repeated profiles are refused."""
        if name in self.profiles:
            raise ValueError(f"profile {name!r} is loaded twice")
        known = {f.name for f in fields(self)} - {"profiles"}
        if unknown := set(more) - known:
            raise ValueError(f"profile {name!r} registers unknown kinds: {sorted(unknown)}")
        added = {k: getattr(self, k) + tuple(x for x in v if x not in getattr(self, k)) for k, v in more.items()}
        return replace(self, **added, profiles=(*self.profiles, name))


# What each vendor profile registers, in loading order.
PROFILES: dict[str, dict[str, tuple]] = {
    "cloudflare": {
        "script_ref_dirs": ("cf-fonts", "cdn-cgi"),
        "skip_ref_prefixes": ("/cdn-cgi/l/email-protection",),
        "skip_prefixes": ("/cdn-cgi/",),
        "beacons": (("cloudflare-beacon", "src", "cloudflareinsights.com"),),
    },
    "complianz": {"url_attrs": ("data-cmplz-src", "data-src-cmplz")},
    "lazyload": {
        "url_attrs": ("data-src", "data-lazy-src", "data-bg"),
        "srcset_attrs": ("data-srcset", "data-lazy-srcset"),
        "css_url_attrs": ("data-bg",),
        "lazy_img_attrs": ("data-src", "data-lazy-src"),
    },
    "slider": {"b64_url_attrs": ("data-dbsrc",)},
    "theme": {
        "url_attrs": ("data-placeholder-image",),
        "page_url_attrs": ("data-dt-location",),
        "noise_patterns": ((r"(?i)\b[0-9a-f]{8,}\b", "H"), (r"-\d{2,7}\b", "-N")),
    },
    "wordfence": {"beacons": (("wordfence-beacon", "text", "wordfence_lh"), ("wordfence-beacon", "text", "wfLogHumanRan"))},
    "wordpress": {"dynamic_paths": (r"/cart/?$", r"/checkout/?$"), "skip_prefixes": ("/wpforms-ajax",)},
}


def load_rules(names: tuple[str, ...] | None = None) -> Rules:
    """Base rules with the named profiles, all of them by default; an unknown name fails."""
    rules = Rules()
    for name in PROFILES if names is None else names:
        rules = rules.merged(name, **PROFILES[name])
    return rules


@dataclass(frozen=True)
class Site:
    """One site: where it lives, which hosts are its own, what is left out."""

    base: str
    own_hosts: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    target: str = ""
    rules: Rules = field(default_factory=load_rules)
    include_linked: bool = False
    sitemap_found: bool = True
