"""Regular expressions of the notice fields.

They stay inside what Java and RE2 share (no look-around, no back-references); letters
with accents are spelled out because case folding of them differs between engines.
Patterns of lower-cased text are marked LOW.
"""

DATE_SLASH = r"(\d{1,2})/(\d{1,2})/(\d{4})"
DATE_WORDS_LOW = r"(\d{1,2})(?:er)?\s+([a-zà-ÿ]+)\s+(\d{4})"

PRICES_LOW = [
    r"mise\s+[àa]\s+prix\s*:?\s*([\d\s,.]+)",
    r"prix\s*:?\s*([\d\s,.]+)\s*(?:€|euros?)",
    r"([\d\s,.]+)\s*(?:€|euros?)",
]
SALE_DATES_LOW = [
    r"(?:vente|adjudication|audience)\s+(?:le\s+)?(\d{1,2}(?:er)?\s+[a-zà-ÿ]+\s+\d{4})",
    r"(\d{1,2}(?:er)?\s+[a-zà-ÿ]+\s+\d{4})\s+à\s+\d{1,2}h",
    r"(?:vente|adjudication|audience)\s+(?:le\s+)?(\d{1,2}/\d{1,2}/\d{4})",
    r"le\s+(\d{1,2}/\d{1,2}/\d{4})",
]
SALE_TIME = r"[àa]\s+(\d{1,2})\s*[hH:]\s*(\d{0,2})"
# (dates, hours) by group; the first pattern with a valid date decides
VISITS_LOW = [
    r"visite\s+(?:sur\s+place\s+)?(?:[a-zà-ÿ]+\s+)?(\d{1,2}(?:er)?\s+[a-zà-ÿ]+\s+\d{4})\s+de\s+(\d{1,2})h",
    r"visites?\s+(?:les?\s+)?(\d{1,2}(?:er)?\s+[a-zà-ÿ]+\s+\d{4})(?:\s+[àa]\s+(\d{1,2})h)?",
]
VISIT_SECTION_LOW = r"visites?\s*:?\s*([^\n]+)"
VISIT_SECTION_DATE = r"(\d{1,2}/\d{1,2}/\d{4})"

SURFACES_LOW = [
    r"surface\s*(?:habitable|totale)?\s*(?:de\s*)?(\d+(?:[.,]\d+)?)\s*m[²2]",
    r"(\d+(?:[.,]\d+)?)\s*m[²2]",
]
ROOMS_LOW = r"(\d+)\s*(?:pièces?|pieces?|p\.)"
BEDROOMS_LOW = r"(\d+)\s*(?:chambres?|ch\.)"
FLOOR_LOW = r"(\d+)(?:ème|er|e)?\s*étage"

AGENT_MARKERS = ["Maître ", "Maitre ", "Avocat", "Cabinet ", "AARPI ", "SCP ", "SELARL "]
ADDRESSES = [
    r"(?i)(\d+[,\s]+(?:chemin|ch\.|rue|avenue|av\.|boulevard|bd\.|all[ée]e|all\.|impasse|imp\.|cours|route|rte\.)\s+[^,\n]{5,80})\s*(?:à|,)",
    r"(?i)(\d+[,\s]+(?:chemin|ch\.|rue|avenue|av\.|boulevard|bd\.|all[ée]e|all\.|impasse|imp\.|cours|route|rte\.)[^,\n\d]{5,60})",
    r"(\d+[,\s]+place\s+(?:de\s+(?:la\s+)?)?[A-ZÀ-Ü][a-zà-ü]+[^,\n]{0,40})",
    r"(?i)((?:chemin|ch\.|rue|avenue|av\.|boulevard|bd\.|all[ée]e|all\.|impasse|imp\.|cours|route|rte\.)\s+(?:de\s+|du\s+|des\s+)?[A-ZÀ-Ü][^,\n]{5,60})",
]
NOT_ADDRESS_LOW = (
    r"tél|tel|fax|\d{2}[\s.]\d{2}[\s.]\d{2}[\s.]\d{2}|lundi|mardi|mercredi|jeudi|vendredi|samedi|dimanche"
    r"|janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre|\d{1,2}h\d{0,2}\s*à"
)
# place named in the sentence that describes the property
PLACE_IN_SENTENCE = r"(?i)(?:Un|Une|Le|La)\s+(?:appartement|maison|local|terrain|parking)[^.]*?(?:à|situé|sis)\s+([^,\n.]{10,80})"
NOT_PLACE = r"(?i)n°\d+|mise à prix|Bouches-du-Rhône|Var"
URL_CITY = r"/([a-z\-]+)-(\d{2})/"
URL_REGION_CITY = r"(?i)/([a-z\-]+?)(?:-(\d+)(?:eme|er)?)?/(?:var|bouches-du-rhone)/"
URL_DISTRICT_CITY = r"(?i)/(marseille|aix|toulon)[^/]*-(\d+)(?:eme|er)?/"
CITY_AFTER_A = r"à\s+([A-ZÀ-Ü][a-zà-ü\-]+(?:\s+\d+[eè]me)?)"

AGENT_NAMES = [
    r"(?:Maître|Me|Mtre)\s+([A-ZÀ-Ü][a-zà-ü]+(?:[- ][A-ZÀ-Ü][a-zà-ü]+)*)",
    r"(?:Cabinet|SCP|SELARL)\s+([A-ZÀ-Ü][^,\n]{3,50})",
    r"Avocat\s*:\s*([A-ZÀ-Ü][^,\n]{3,50})",
]
PHONES = [
    r"(?:Tél\.?|Tel\.?|Téléphone)\s*:?\s*([\d\s.]+)",
    r"(0[1-9][\s.]?\d{2}[\s.]?\d{2}[\s.]?\d{2}[\s.]?\d{2})",
]
EMAIL = r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"
FIRM = r"((?:AARPI|SCP|SELARL|Cabinet)\s+[^,\n]+)"
AGENT_ADDRESS = r"(?i)(\d+[,\s]+(?:rue|avenue|boulevard|cours|place)[^-\n]{5,80}[-\s]+\d{5}\s+[\wÀ-ÿ]+)"
MAILTO = r"""href=["']mailto:([^"'?]+)"""
AGENT_SITES = [
    r"""<a\s[^>]*class=["'](?:site|website)["'][^>]*href=["']([^"']+)["']""",
    r"""<a\s[^>]*href=["']([^"']+)["'][^>]*class=["'](?:site|website)["']""",
    r"""<a\s[^>]*href=["'](https?://[^"']*avocat[^"']*)["']""",
]
COURT_LOW = r"tribunal\s+(?:judiciaire|de grande instance)\s+(?:de\s+)?([a-zà-ÿ\-]+)"

OCCUPANCY_LOW = [
    (r"occupation[^\n:]*:\s*([^\n,]+)", None),
    (r"(libre\s+de\s+toute\s+occupation)", "Libre"),
    (r"(occupée?)", "Occupé"),
    (r"bien\s+(libre|vacant)", "Libre"),
    (r"(locataire|bail|location)", "Occupé"),
]
OCCUPANCY_JSON = r'"critere_occupation[^"]*"\s*:\s*"([^"]+)"'
TENANT_LOW = r"(?:locataire|occupant)\s*:?\s*([^\n]+)"
RENT_LOW = r"loyer\s+(?:mensuel)?\s*:?\s*([\d\s,.]+)\s*€"
PARCEL_SECTION = r"[Ss]ection\s+([A-Z]{1,2})\s*n[°º]?\s*(\d+)"
PARCELS = [
    r"[Cc]adastr[ée]\s*:?\s*([A-Z]{1,2}\s*\d+)",
    r"[Pp]arcelle\s+([A-Z]{1,2}\s*\d+)",
    r"[Rr]éférence\s+cadastrale\s*:?\s*([A-Z0-9\s]+)",
]
LOT_LOW = r"lot\s*n?°?\s*(\d+)"
CHARGES_LOW = r"charges\s+(?:annuelles|de copropriété)?\s*:?\s*([\d\s,.]+)\s*€"
SHARES_LOW = r"(\d+)\s*/?\s*(?:\d+)?\s*tantièmes?"
START_PRICE_LOW = r"mise\s+[àa]\s+prix\s*:?\s*([\d\s,.]+)\s*(?:€|euros?)"
FEES_LOW = r"frais\s+(?:prévisionnels|estimés)\s*:?\s*([\d\s,.]+)\s*(?:€|euros?)"
DEBT_LOW = r"(?:créance|montant\s+dû)\s*:?\s*([\d\s,.]+)\s*(?:€|euros?)"
CASE_NUMBER = r"(?:RG|n°)\s*(\d{2}/\d+)"
DESCRIPTIONS = [
    r"(?is)(?:description|d[ée]signation)\s*:?\s*(.{100,})",
    r"(?is)(?:le bien|l'immeuble)\s+(?:comprend|se compose)\s+(.{100,})",
]

SOURCE_IDS = {
    "site_a": r"/annonce/(\d+)/",
    "site_b": r"/(\d+)-",
    "site_c": r"(?:_(\d+)$|/(\d+)(?:\?|$))",
}
LINK = r"""<a\s[^>]*href=["']([^"']+)["'][^>]*>"""
LINK_TEXT = r"""<a\s[^>]*href=["'][^"']+["'][^>]*>([^<]*)</a>"""
LINK_HREF = r"""<a\s[^>]*href=["']([^"']+)["'][^>]*>[^<]*</a>"""
PROPERTY_LINK = r"/encheres/immobilier/(?:appartements|maisons|immeubles|terrains|parkings|locaux-commerciaux|biens-exception)/.*_"
JSON_FILE = r'"file"\s*:\s*"([^"]+\.pdf)"\s*,\s*"nom"\s*:\s*"[^"]+"'
JSON_FILE_NAME = r'"file"\s*:\s*"[^"]+\.pdf"\s*,\s*"nom"\s*:\s*"([^"]+)"'
IMAGE_TAG = r"(<img\s[^>]*>)"
IMAGE_SOURCES = [r"""\ssrc=["']([^"']+)["']""", r"""\sdata-src=["']([^"']+)["']""", r"""\sdata-lazy=["']([^"']+)["']"""]
IMAGE_SET = r"""\ssrcset=["']([^"']+)["']"""
PHOTO_LIST = r"""data-(?:photos|images)='([^']+)'"""
STREET_VIEW = r"""(streetview\?adresse_id=\d+[^"']*)"""
STREET_VIEW_PATH = "/back/services/"
REDIRECT = r"uddg=([^&]+)"
STATIC_PHOTO = r"""(/static/lot/photo/[^"']+\.jpg)"""
NEXT_IMAGE = r"url=([^&]+)"
SOLD_PRICE_LOW = r"adjugé\s*(?:à)?\s*[:\s]*(\d[\d\s]*)\s*€"
CARD_SURFACE_LOW = r"(\d+[,.]?\d*)\s*m²"
CARD_PRICE = r"(\d[\d\s]*)\s*€"
DISTRICT_LOW = r"marseille\s*(\d+)(?:ème|er|e)?"
JSON_LD = r"""(?s)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
NEXT_DATA = r"""(?s)<script[^>]*id=["']__NEXT_DATA__["'][^>]*>(.*?)</script>"""
AREA_IN_TEXT = r"(\d+(?:[.,]\d+)?)\s*m²"


def postal_pattern(departments) -> str:
    return r"\b((?:" + "|".join(departments) + r")\d{3})\b"


def city_after_postal(departments) -> str:
    return r"\b(?:" + "|".join(departments) + r")\d{3}\s+([A-ZÀ-Ü][A-Za-zà-ü\-]+(?:[ \t]+[A-ZÀ-Ü][A-Za-zà-ü\-]+)*)"


def named_city(city: str) -> str:
    """The city as a word of its own in lower-cased text."""
    return rf"(?:^|[^a-zà-ÿ0-9]){city}(?:[^a-zà-ÿ0-9]|$)"
