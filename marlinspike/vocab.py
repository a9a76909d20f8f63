"""Reference vocabularies: fixed values that results depend on, stated in their order of precedence."""

from __future__ import annotations

import json
from pathlib import Path

#: Profession keys and their aliases; fixed values. Longest alias wins, then the earlier line.
PROFESSIONS = {
    "master": ["master", "captain"],
    "chief_officer": ["chief officer", "chief mate", "first officer", "first mate"],
    "second_officer": ["second officer", "second mate", "2nd off"],
    "third_officer": ["third officer", "third mate", "3rd off", "jdpo"],
    "deck_officer": ["deck officer", "watch officer"],
    "able_seaman": ["able seaman", "ordinary seaman", "lasher", "deckhand"],
    "boatswain": ["boatswain", "bosun"],
    "barge_pilot": ["barge pilot"],
    "crane_operator": ["crane operator", "excavator operator"],
    "chief_engineer": ["chief engineer", "cheng"],
    "second_engineer": ["second engineer", "2nd engineer"],
    "third_engineer": ["third engineer", "3rd engineer"],
    "fourth_engineer": ["fourth engineer", "4th engineer"],
    "electro_technical_officer": ["electro-technical officer", "electrical engineer", "eto"],
    "gas_engineer": ["gas engineer"],
    "motorman": ["motorman", "oiler", "wiper", "pumpman", "donkerman"],
    "fitter": ["fitter", "welder"],
    "ship_cook": ["chief cook", "ship cook", "mess boy", "messmaid"],
    "steward": ["steward", "stewardess", "steward (-ess)"],
    "galley": ["galley", "chef", "cook", "baker", "butcher", "culinary", "pastry"],
    "guest_services": ["guest svc", "guest service", "receptionist", "concierge", "front desk", "shorex", "shore excursion"],
    "housekeeping": ["housekeeping", "stateroom", "laundry", "cleaner"],
    "rooms_division": ["rooms division", "florist rooms"],
    "beverage_service": ["beverage svc", "fb svc", "beverage", "bartender", "bar server", "sommelier"],
    "entertainment": ["entertainment", "musician", "dancer", "youth staff", "broadcast"],
    "restaurant_service": ["restaurant", "waiter", "dining", "maitre"],
    "human_resources": ["human resources", "human resource", "hr manager", "crew officer"],
    "marine_engineering": ["technical", "engineer", "electrician", "refrigeration", "plumber", "fitter"],
    "deck": ["deck", "officer", "bosun", "sailor", "carpenter"],
    "medical": ["doctor", "nurse", "medical"],
    "spa_and_fitness": ["spa", "fitness", "therapist", "trainer", "onsen"],
    "security": ["security"],
    "retail": ["retail", "shop"],
    "photographer": ["photographer", "photo manager", "photo supervisor", "photo video"],
    "provisions": ["provision master", "provisions", "storekeeper", "store keeper", "stores"],
    "hotel_maintenance": ["fitter carpet", "carpet fitter", "upholsterer", "tailor"],
    "dive_instructor": ["scuba instructor", "dive instructor", "diving instructor", "freediver instructor", "course director", "owsi", "msdt", "idc staff"],
    "divemaster": ["divemaster", "dive master"],
    "dive_technician": ["equipment technician", "service technician", "fill station", "boat mechanic"],
}
#: Country codes and names; fixed values.
COUNTRIES = {
    "GB": ["United Kingdom", "UK", "England", "Scotland", "Wales"],
    "US": ["United States", "USA"],
    "NL": ["Netherlands"],
    "DE": ["Germany"],
    "PL": ["Poland"],
    "FR": ["France"],
    "ES": ["Spain"],
    "IT": ["Italy"],
    "IN": ["India"],
    "ID": ["Indonesia"],
    "PH": ["Philippines"],
    "TH": ["Thailand"],
    "MV": ["Maldives"],
    "GR": ["Greece"],
    "AU": ["Australia"],
    "LK": ["Sri Lanka"],
    "CA": ["Canada"],
    "AE": ["United Arab Emirates", "UAE"],
    "EG": ["Egypt"],
    "DO": ["Dominican Republic"],
    "VI": ["Virgin Islands (U.S.)", "U.S. Virgin Islands"],
    "BS": ["Bahamas"],
    "BQ": ["Caribbean Netherlands"],
    "CO": ["Colombia"],
    "MG": ["Madagascar"],
    "KY": ["Cayman Islands"],
    "HN": ["Honduras"],
    "SA": ["Saudi Arabia"],
    "MX": ["Mexico"],
    "PT": ["Portugal"],
    "CR": ["Costa Rica"],
    "FJ": ["Fiji"],
    "CY": ["Cyprus"],
    "TZ": ["Tanzania"],
    "BR": ["Brazil"],
    "EC": ["Ecuador"],
    "VN": ["Vietnam"],
    "SC": ["Seychelles"],
    "ZA": ["South Africa"],
    "JO": ["Jordan"],
    "PR": ["Puerto Rico"],
    "PW": ["Palau"],
    "FM": ["Micronesia"],
    "MZ": ["Mozambique"],
    "BE": ["Belgium"],
    "TC": ["Turks and Caicos Islands"],
    "JP": ["Japan"],
    "MY": ["Malaysia"],
    "KR": ["South Korea"],
    "CN": ["China"],
    "SG": ["Singapore"],
    "TW": ["Taiwan"],
    "HK": ["Hong Kong"],
    "PA": ["Panama"],
    "NI": ["Nicaragua"],
    "GY": ["Guyana"],
}
#: Certificate keys and patterns; fixed values. Some keys have no pattern on purpose.
CERTIFICATES = {
    "stcw": ["STCW", "Basic Safety", "BST"],
    "seaman_book": ["seaman book", "seaman's book", "seafarer book"],
    "passport": ["passport"],
    "c1d_visa": ["C1/D", "C-1/D", "C1D visa"],
    "marine_medical": ["marine fitness medical", "seafarer medical", "medical certificate", "medical fitness"],
    "marlins": ["Marlins", "Marlin test"],
    "usph": ["USPH", "U.S. Public Health"],
    "food_hygiene": ["Food Hygiene", "Food and Hygiene"],
    "coc": ["COC", "Certificate of Competency"],
    "dynamic_positioning": ["Dynamic Positioning", "DP"],
    "gmdss": ["GMDSS"],
    "ces_test": ["CES test", "CES tests", "CES"],
    "bosiet": ["BOSIET"],
    "huet": ["HUET"],
    "fast_rescue_boat": ["Fast Rescue Boat", "FRB"],
    "servsafe": ["ServSafe"],
    "haccp": ["HACCP"],
    "crowd_management": ["crowd management"],
    "padi": [],
    "ssi": ["SSI"],
    "imca": ["IMCA"],
    "hse_diving": ["HSE diving", "HSE diver"],
}
#: Language keys and names; fixed values.
LANGUAGES = {
    "en": ["English"],
    "ja": ["Japanese"],
    "nl": ["Dutch"],
    "de": ["German"],
    "es": ["Spanish"],
    "it": ["Italian"],
    "fr": ["French"],
    "pt": ["Portuguese"],
    "zh": ["Mandarin", "Chinese"],
    "ru": ["Russian"],
    "ko": ["Korean"],
}
#: Directions a posting or a person may name; fixed values.
DIRECTIONS = ["general_maritime", "cruise", "education", "superyachts", "diving", "commercial_diving", "offshore", "fishing", "science"]
#: Declared types and title keywords of opportunity types; fixed values, keywords in order of precedence.
DECLARED_TYPES = {"fixed_term_contract": "job", "contract": "job", "permanent": "job", "internship": "internship", "volunteer": "volunteer"}
TYPE_KEYWORDS = {"internship": "internship", "volunteer": "volunteer", "course": "course", "certification": "certification", "research": "research", "event": "event"}
#: Enumerations; fixed values.
OPPORTUNITY_TYPES = ["job", "internship", "volunteer", "course", "certification", "article", "news", "research", "event"]
EXPERIENCE_LEVELS = ["entry", "junior", "mid", "senior", "lead"]
CAREER_STAGES = ["undecided", "entry", "working", "experienced"]
STAGE_LEVELS = {"entry": ["entry", "junior"], "working": ["junior", "mid"], "experienced": ["mid", "senior", "lead"]}
PROVENANCES = ["source", "rule", "llm"]
JUNK_TITLES = ["untitled", "n/a", "test", "-"]


def terms(vocabulary: dict[str, list[str]]) -> list[tuple[str, str, int]]:
    """(key, term, order) of every term, in order."""
    return [(k, t, i) for i, (k, t) in enumerate((k, t) for k, ts in vocabulary.items() for t in ts)]


def load_mapping(path: str) -> dict:
    """A dictionary file as a mapping: JSON, or YAML where the yaml package is there; anything but a mapping is an error."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        found = json.loads(text)
    except ValueError:
        import yaml

        found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    return found


def vocabulary(path: str, section: str, key: str = "key", words: str = "aliases") -> dict[str, list[str]]:
    """key -> words of a dictionary file's section, a list of entries with a key and a list of words, in written order."""
    return {str(e[key]): [str(w) for w in e.get(words) or []] for e in load_mapping(path).get(section) or []}
