"""Options with their defaults and checks, enumerations, and the fixed output columns."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum, IntEnum

BASE_URL = "https://play.google.com"


class Sort(IntEnum):
    HELPFULNESS = 1
    NEWEST = 2
    RATING = 3


class Collection(Enum):
    TOP_FREE = "TOP_FREE"
    TOP_PAID = "TOP_PAID"
    GROSSING = "GROSSING"


class Age(Enum):
    ALL = ""
    FIVE_UNDER = "AGE_RANGE1"
    SIX_EIGHT = "AGE_RANGE2"
    NINE_UP = "AGE_RANGE3"


# Category identifiers in their order, apps before games.
APP_CATEGORIES = """APPLICATION ANDROID_WEAR ART_AND_DESIGN AUTO_AND_VEHICLES BEAUTY BOOKS_AND_REFERENCE BUSINESS COMICS
COMMUNICATION DATING EDUCATION ENTERTAINMENT EVENTS FAMILY FINANCE FOOD_AND_DRINK HEALTH_AND_FITNESS HOUSE_AND_HOME
LIBRARIES_AND_DEMO LIFESTYLE MAPS_AND_NAVIGATION MEDICAL MUSIC_AND_AUDIO NEWS_AND_MAGAZINES PARENTING PERSONALIZATION
PHOTOGRAPHY PRODUCTIVITY SHOPPING SOCIAL SPORTS TOOLS TRAVEL_AND_LOCAL VIDEO_PLAYERS WATCH_FACE WEATHER""".split()
GAME_CATEGORIES = """GAME GAME_ACTION GAME_ADVENTURE GAME_ARCADE GAME_BOARD GAME_CARD GAME_CASINO GAME_CASUAL
GAME_EDUCATIONAL GAME_MUSIC GAME_PUZZLE GAME_RACING GAME_ROLE_PLAYING GAME_SIMULATION GAME_SPORTS GAME_STRATEGY
GAME_TRIVIA GAME_WORD""".split()
CATEGORIES = APP_CATEGORIES + GAME_CATEGORIES

PAGE_MOST, SEARCH_MOST = 150, 250


def _required(value: str, name: str) -> None:
    if not value:
        raise ValueError(f"{name} is required")


def _number(value: int, default: int) -> int:
    if value < 0:
        raise ValueError("a number of results can't be negative")
    return value or default


@dataclass(frozen=True)
class Locale:
    lang: str = "en"
    country: str = "us"


@dataclass(frozen=True)
class AppOptions(Locale):
    app_id: str = ""

    def __post_init__(self):
        _required(self.app_id, "app id")


class PermissionsOptions(AppOptions):
    pass


class DataSafetyOptions(AppOptions):
    pass


@dataclass(frozen=True)
class SearchOptions(Locale):
    term: str = ""
    num: int = 0
    price: str = "all"
    full_detail: bool = False

    def __post_init__(self):
        _required(self.term, "search term")
        if self.num > SEARCH_MOST:
            raise ValueError(f"at most {SEARCH_MOST} results")
        object.__setattr__(self, "num", _number(self.num, 20))


@dataclass(frozen=True)
class ReviewOptions(Locale):
    """``count`` is a page's size for one page, the total for all pages, the total of each rating for the comprehensive query."""

    app_id: str = ""
    sort: Sort = Sort.NEWEST
    count: int = 0
    filter_score: int = 0
    next_token: str = ""

    def page_size(self) -> int:
        return min(_number(self.count, PAGE_MOST), PAGE_MOST)

    def total(self) -> int:
        return _number(self.count, 500)

    def per_rating(self) -> int:
        return _number(self.count, 200)


@dataclass(frozen=True)
class DeveloperOptions(Locale):
    dev_id: str = ""
    num: int = 0
    full_detail: bool = False

    def __post_init__(self):
        _required(self.dev_id, "developer id")
        object.__setattr__(self, "num", _number(self.num, 60))


@dataclass(frozen=True)
class SimilarOptions(Locale):
    app_id: str = ""
    full_detail: bool = False

    def __post_init__(self):
        _required(self.app_id, "app id")


@dataclass(frozen=True)
class SuggestOptions(Locale):
    term: str = ""

    def __post_init__(self):
        _required(self.term, "term")


@dataclass(frozen=True)
class ListOptions(Locale):
    collection: Collection = Collection.TOP_FREE
    category: str = "APPLICATION"
    age: Age = Age.ALL
    num: int = 0
    full_detail: bool = False

    def __post_init__(self):
        object.__setattr__(self, "num", _number(self.num, 60))


#: Columns of a search result, in their order; all layouts give these.
RESULT = ["app_id", "title", "url", "icon", "developer", "developer_id", "summary", "score", "score_text", "price", "currency", "free"]
