"""Lookup tables and constants that results depend on, stated plainly."""

from __future__ import annotations

#: Team names and short forms to the three-letter code.
TEAM_CODES = {
    "Anaheim Ducks": "ANA",
    "Boston Bruins": "BOS",
    "Buffalo Sabres": "BUF",
    "Calgary Flames": "CGY",
    "Carolina Hurricanes": "CAR",
    "Chicago Blackhawks": "CHI",
    "Colorado Avalanche": "COL",
    "Columbus Blue Jackets": "CBJ",
    "Dallas Stars": "DAL",
    "Detroit Red Wings": "DET",
    "Edmonton Oilers": "EDM",
    "Florida Panthers": "FLA",
    "Los Angeles Kings": "LAK",
    "Minnesota Wild": "MIN",
    "Montreal Canadiens": "MTL",
    "Nashville Predators": "NSH",
    "New Jersey Devils": "NJD",
    "New York Islanders": "NYI",
    "New York Rangers": "NYR",
    "Ottawa Senators": "OTT",
    "Philadelphia Flyers": "PHI",
    "Pittsburgh Penguins": "PIT",
    "San Jose Sharks": "SJS",
    "Seattle Kraken": "SEA",
    "St Louis Blues": "STL",
    "Tampa Bay Lightning": "TBL",
    "Toronto Maple Leafs": "TOR",
    "Vancouver Canucks": "VAN",
    "Vegas Golden Knights": "VGK",
    "Washington Capitals": "WSH",
    "Winnipeg Jets": "WPG",
    "Utah Hockey Club": "UTA",
    "Arizona Coyotes": "ARI",
    "T.B": "TBL",
    "S.J": "SJS",
    "L.A": "LAK",
    "N.J": "NJD",
    "T.B.": "TBL",
    "S.J.": "SJS",
    "L.A.": "LAK",
    "N.J.": "NJD",
}

#: Spellings of a person's name to the one that is kept, after accents, case and punctuation are gone.
NAME_SPELLINGS = {
    "mat?j blumel": "matej blumel",
    "mat j blumel": "matej blumel",
    "alex nylander": "alexander nylander",
    "alex petrovic": "alexander petrovic",
    "frederick gaudreau": "freddy gaudreau",
    "john jack roslovic": "jack roslovic",
    "john roslovic": "jack roslovic",
    "joe veleno": "joseph veleno",
    "josh norris": "joshua norris",
    "joshua mahura": "josh mahura",
    "luke glendening": "lucas glendening",
    "matt grzelcyk": "matthew grzelcyk",
    "maxwell crozier": "max crozier",
    "mitch marner": "mitchell marner",
    "tommy novak": "thomas novak",
    "vinnie hinostroza": "vincent hinostroza",
    "zac jones": "zachary jones",
    "zack bolduc": "zachary bolduc",
    "matt dumba": "mathew dumba",
    "christopher tanev": "chris tanev",
    "matt benning": "matthew benning",
    "pat maroon": "patrick maroon",
    "louie belpedio": "louis belpedio",
    "zach sanford": "zachary sanford",
    "william borgen": "will borgen",
    "nicholas merkley": "nick merkley",
    "callan foote": "cal foote",
    "alex kerfoot": "alexander kerfoot",
    "alexei toropchenko": "alexey toropchenko",
    "axel sandin pellikka": "axel sandin-pellikka",
    "c j suess": "cj suess",
    "charles-alexis legault": "charles alexis legault",
    "chris didomenico": "christopher didomenico",
    "danil yurtaikin": "danil yurtaykin",
    "fyodor svechkov": "fedor svechkov",
    "gabe chiarot": "ben chiarot",
    "j t brown": "jt brown",
    "jeremie poirier": "emile poirier",
    "joe labate": "joseph labate",
    "josh brown": "joshua brown",
    "joshua dunne": "josh dunne",
    "lucas pettersson": "elias pettersson",
    "matthew beniers": "matty beniers",
    "nikita okhotyuk": "nikita okhotiuk",
    "nikolay prokhorkin": "nikolai prokhorkin",
    "philip kemp": "phil kemp",
    "sammy blais": "samuel blais",
    "samuel poulin": "sam poulin",
    "samuel walker": "sammy walker",
    "sergei kalinin": "sergey kalinin",
    "t j brennan": "tj brennan",
    "timothy gettinger": "tim gettinger",
    "tj tynan": "t j tynan",
    "vasiliy ponomarev": "vasily ponomarev",
    "vladimir tkachyov": "vladimir tkachev",
    "will bitten": "william bitten",
    "yegor korshkov": "egor korshkov",
    "yegor zamula": "egor zamula",
    "michael matheson": "mike matheson",
    "mike cammalleri": "michael cammalleri",
    "nick shore": "nicholas shore",
    "anthony deangelo": "tony deangelo",
    "cristoval nieves": "boo nieves",
    "daniel o'regan": "danny o'regan",
    "nicholas baptiste": "nick baptiste",
    "jacob middleton": "jake middleton",
    "max comtois": "maxime comtois",
    "gerald mayhew": "gerry mayhew",
    "alex wennberg": "alexander wennberg",
    "alexander chmelevski": "sasha chmelevski",
    "janis moser": "j j moser",
    "nathan smith": "nate smith",
    "nicholas paul": "nick paul",
    "jacob lucchini": "jake lucchini",
    "nick abruzzese": "nicholas abruzzese",
    "cameron atkinson": "cam atkinson",
    "benoit-olivier groulx": "bo groulx",
    "cameron hillis": "cam hillis",
    "zach hayes": "zack hayes",
    "zachary hayes": "zack hayes",
    "janis jerome moser": "j j moser",
    "nicklaus perbix": "nick perbix",
    "cameron york": "cam york",
    "matthew stienburg": "matt stienburg",
    "john-jason peterka": "jj peterka",
    "cal burke": "callahan burke",
    "cameron lund": "cam lund",
    "matthew savoie": "matt savoie",
    "artyom zub": "artem zub",
}

#: Generational suffixes.
NAME_SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")

#: League cap and minimum salary by season, and the growth of the cap beyond the table.
LEAGUE_CAP = {
    "2015-2016": 71400000, "2016-2017": 73000000, "2017-2018": 75000000, "2018-2019": 79500000, "2019-2020": 81500000,
    "2020-2021": 81500000, "2021-2022": 81500000, "2022-2023": 82500000, "2023-2024": 83500000, "2024-2025": 88000000,
    "2025-2026": 95500000, "2026-2027": 104000000, "2027-2028": 113500000,
}
MIN_SALARY = {
    "2015-2016": 575000, "2016-2017": 575000, "2017-2018": 650000, "2018-2019": 650000, "2019-2020": 700000,
    "2020-2021": 700000, "2021-2022": 750000, "2022-2023": 750000, "2023-2024": 775000, "2024-2025": 775000,
}
CAP_GROWTH = 0.05

#: Ages and values of the five knots of each published curve: start, end of rise, end of plateau, end of decline, tail.
AGE_KNOTS = {
    ("Dom", "F"): ((18, 0.10), (24, 1.00), (26, 0.97), (34, 0.20), (38, 0.05)),
    ("Dom", "D"): ((18, 0.12), (26, 1.00), (29, 0.98), (36, 0.20), (38, 0.08)),
    ("Tulsky", "F"): ((18, 0.20), (25, 1.00), (27, 0.95), (35, 0.40), (38, 0.30)),
    ("Tulsky", "D"): ((18, 0.22), (26, 1.00), (29, 0.97), (36, 0.45), (38, 0.35)),
    ("EvolvingWild", "F"): ((18, 0.18), (25, 1.00), (28, 0.98), (35, 0.25), (38, 0.10)),
    ("EvolvingWild", "D"): ((18, 0.20), (26, 1.00), (30, 0.98), (37, 0.30), (38, 0.15)),
}

#: Time on ice a game up to which a role holds; above the last the last holds.
ROLE_LIMITS = {
    "F": (("4th Line", 9.0), ("Bottom-6", 12.0), ("Middle-6", 15.5), ("Top-6", 18.5), ("1st Line", 20.0)),
    "D": (("3rd Pair", 15.0), ("Bottom-4", 18.0), ("Top-4", 20.0), ("1st Pair", 21.5)),
}
ROLE_TIERS = {"F": {"1st Line": 5, "Top-6": 4, "Middle-6": 3, "Bottom-6": 2, "4th Line": 1}, "D": {"1st Pair": 5, "Top-4": 4, "Bottom-4": 2, "3rd Pair": 1}}

#: Valuation constants.
POOL_CUTOFF = {"ES": {"F": 12, "D": 8}, "PP": {"F": 5, "D": 2}, "PK": {"F": 4, "D": 4}}
SHRINK_ES = {"F": 300.0, "D": 260.0}
PRIOR_K = {"ES": 240.0, "PP": 120.0, "PK": 600.0}
CURRENT_K = {"PP": 120.0, "PK": 1200.0}
LAG_DECAY = 0.55
SEASON_BLEND = (0.55, 0.35, 0.10)
PROJECTION_BLEND = (0.6, 0.3, 0.1)
COMPRESS = {"centre": 2.0, "above": 0.6, "below": 0.7}
BLOCK_WEIGHTS = {"USAGE": 2.0, "IMPACT": 1.2, "VALUE": 1.5, "AGE": 2.0, "DEMO": 0.6, "CTX": 1.2}
DASHBOARD = {"gar_per_spar": 2.9245, "usd_per_spar": 1571475.16, "floor": 750000.0}

#: Shot geometry and the shot types that count as unblocked attempts.
GOAL_X = 89.0
ZONE_X = 25.0
FENWICK = ("SHOT-ON-GOAL", "MISSED-SHOT", "GOAL")
STRENGTHS = {"ES": ("5v5",), "PP": ("5v4", "6v5"), "PK": ("4v5", "5v6")}
