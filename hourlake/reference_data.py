"""Code tables of the data providers, regions, coordinates and limits, and report texts."""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------------------------

# fuel_code, fuel_name, category, is_renewable, is_carbon_free
FUEL_TYPES = [
    ("COL", "Coal", "Fossil", False, False),
    ("NG", "Natural Gas", "Fossil", False, False),
    ("NUC", "Nuclear", "Carbon-free firm", False, True),
    ("OIL", "Petroleum", "Fossil", False, False),
    ("WAT", "Hydro", "Renewable", True, True),
    ("WND", "Wind", "Renewable", True, True),
    ("SUN", "Solar", "Renewable", True, True),
    ("GEO", "Geothermal", "Renewable", True, True),
    ("BIO", "Biomass", "Renewable", True, False),
    ("OTH", "Other", "Other", False, False),
]

# Fuels that always keep a band of their own, names for codes the source leaves unnamed, the
# catch-all code, the share from which another fuel gets a band, and the most bands with a name.
PRIMARY_FUELS = ["NG", "NUC", "COL", "WAT", "WND", "SUN"]
FUEL_LABELS = {"BAT": "Battery", "PS": "Pumped Storage"}
CATCH_ALL_FUEL = "OTH"
OTHER_LABEL = "Other"
BAND_SHARE_PCT = 1.5
MAX_NAMED_BANDS = 8
TOP_ZONES = 6

# ba_code, ba_name, region, country, timezone
BALANCING_AUTHORITIES = [
    ("PJM", "PJM Interconnection", "Mid-Atlantic", "US", "America/New_York"),
    ("MISO", "Midcontinent ISO", "Midwest", "US", "America/Chicago"),
    ("ERCO", "ERCOT", "Texas", "US", "America/Chicago"),
    ("CISO", "California ISO", "West", "US", "America/Los_Angeles"),
    ("SWPP", "Southwest Power Pool", "Plains", "US", "America/Chicago"),
    ("NYIS", "New York ISO", "Northeast", "US", "America/New_York"),
    ("ISNE", "ISO New England", "Northeast", "US", "America/New_York"),
    ("SOCO", "Southern Company", "Southeast", "US", "America/New_York"),
    ("TVA", "Tennessee Valley Authority", "Southeast", "US", "America/Chicago"),
    ("FPL", "Florida Power & Light", "Southeast", "US", "America/New_York"),
    ("BPAT", "Bonneville Power Administration", "Northwest", "US", "America/Los_Angeles"),
    ("DUK", "Duke Energy Carolinas", "Southeast", "US", "America/New_York"),
    ("AECI", "Associated Electric Cooperative", "Midwest", "US", "America/Chicago"),
    ("PACE", "PacifiCorp East", "West", "US", "America/Denver"),
    ("PACW", "PacifiCorp West", "West", "US", "America/Los_Angeles"),
    ("PSCO", "Public Service Co of Colorado", "West", "US", "America/Denver"),
    ("AZPS", "Arizona Public Service", "Southwest", "US", "America/Phoenix"),
    ("LDWP", "Los Angeles Dept of Water and Power", "West", "US", "America/Los_Angeles"),
    ("NEVP", "Nevada Power", "West", "US", "America/Los_Angeles"),
    ("SRP", "Salt River Project", "Southwest", "US", "America/Phoenix"),
    ("TEPC", "Tucson Electric Power", "Southwest", "US", "America/Phoenix"),
    ("IPCO", "Idaho Power", "West", "US", "America/Boise"),
    ("PSEI", "Puget Sound Energy", "Northwest", "US", "America/Los_Angeles"),
    ("SCEG", "Dominion Energy South Carolina", "Southeast", "US", "America/New_York"),
    ("CPLE", "Duke Energy Progress East", "Southeast", "US", "America/New_York"),
    ("PGE", "Portland General Electric", "Northwest", "US", "America/Los_Angeles"),
    ("BANC", "Balancing Authority of Northern California", "West", "US", "America/Los_Angeles"),
    ("SCL", "Seattle City Light", "Northwest", "US", "America/Los_Angeles"),
    ("NWMT", "NorthWestern Energy", "Northwest", "US", "America/Denver"),
    ("TEC", "Tampa Electric", "Southeast", "US", "America/New_York"),
    ("JEA", "Jacksonville Electric Authority", "Southeast", "US", "America/New_York"),
    ("AVA", "Avista", "Northwest", "US", "America/Los_Angeles"),
    ("WACM", "Western Area Power Rocky Mountain", "West", "US", "America/Denver"),
    ("WALC", "Western Area Power Lower Colorado", "Southwest", "US", "America/Phoenix"),
]

# ba_code, latitude, longitude
BA_CENTROIDS = [
    ("PJM", 39.95, -76.0), ("MISO", 41.5, -89.0), ("ERCO", 31.0, -98.0), ("CISO", 36.0, -119.5),
    ("SWPP", 37.0, -98.0), ("NYIS", 42.7, -75.5), ("ISNE", 42.5, -71.5), ("SOCO", 33.0, -85.0),
    ("TVA", 35.5, -86.0), ("FPL", 27.0, -81.0), ("BPAT", 45.5, -121.0), ("DUK", 35.5, -81.0),
    ("AECI", 37.5, -93.5), ("PACE", 41.0, -111.5), ("PACW", 43.5, -122.5), ("PSCO", 39.5, -105.0),
    ("AZPS", 33.5, -112.0), ("SRP", 33.5, -112.0), ("LDWP", 34.0, -118.0), ("NEVP", 36.2, -115.2),
    ("TEPC", 32.2, -110.9), ("IPCO", 43.6, -116.3), ("JEA", 30.3, -81.6), ("TEC", 27.9, -82.5),
    ("SCEG", 33.7, -81.0), ("CPLE", 35.7, -78.6), ("PSEI", 47.6, -122.3), ("AVA", 47.6, -117.4),
    ("PGE", 45.5, -122.7), ("SCL", 47.6, -122.3), ("NWMT", 46.6, -112.0), ("BANC", 38.6, -121.5),
    ("IID", 33.0, -115.5),
]

# zone_eic, zone_name, latitude, longitude
EUROPE_ZONES = [
    ("10YDE-VE-------2", "Germany (50Hertz)", 52.4, 13.2),
    ("10YFR-RTE------C", "France", 46.8, 2.5),
    ("10YGB----------A", "Great Britain", 52.9, -1.5),
    ("10YES-REE------0", "Spain", 40.4, -3.7),
    ("10YIT-GRTN-----B", "Italy (North)", 45.4, 9.5),
    ("10YNL----------L", "Netherlands", 52.1, 5.3),
    ("10YBE----------2", "Belgium", 50.6, 4.5),
    ("10YPT-REN------W", "Portugal", 39.5, -8.0),
    ("10YPL-AREA-----S", "Poland", 52.1, 19.4),
    ("10YAT-APG------L", "Austria", 47.6, 14.1),
    ("10YCH-SWISSGRIDZ", "Switzerland", 46.8, 8.2),
    ("10YDK-1--------W", "Denmark (DK1)", 56.0, 9.5),
    ("10YDK-2--------M", "Denmark (DK2)", 55.6, 12.0),
    ("10YNO-2--------T", "Norway (NO2)", 58.8, 6.5),
    ("10YSE-1--------K", "Sweden (SE1)", 65.6, 22.0),
    ("10YFI-1--------U", "Finland", 62.5, 25.7),
    ("10YIE-1001A00010", "Ireland", 53.3, -7.7),
    ("10YCZ-CEPS-----N", "Czech Republic", 49.8, 15.5),
    ("10YHU-MAVIR----U", "Hungary", 47.2, 19.4),
    ("10YGR-HTSO-----Y", "Greece", 39.0, 22.0),
]

PRODUCTION_TYPES = {
    "B01": "Biomass",
    "B02": "Fossil Brown coal/Lignite",
    "B03": "Fossil Coal-derived gas",
    "B04": "Fossil Gas",
    "B05": "Fossil Hard coal",
    "B06": "Fossil Oil",
    "B07": "Fossil Oil shale",
    "B08": "Fossil Peat",
    "B09": "Geothermal",
    "B10": "Hydro Pumped Storage",
    "B11": "Hydro Run-of-river and poundage",
    "B12": "Hydro Water Reservoir",
    "B13": "Marine",
    "B14": "Nuclear",
    "B15": "Other renewable",
    "B16": "Solar",
    "B17": "Waste",
    "B18": "Wind Offshore",
    "B19": "Wind Onshore",
    "B20": "Other",
}

# WMO 4677 weather codes
WMO_TEXT = {
    0: "Clear sky",
    1: "Mainly clear",
    2: "Partly cloudy",
    3: "Overcast",
    45: "Fog",
    48: "Depositing rime fog",
    51: "Light drizzle",
    53: "Moderate drizzle",
    55: "Dense drizzle",
    56: "Light freezing drizzle",
    57: "Dense freezing drizzle",
    61: "Slight rain",
    63: "Moderate rain",
    65: "Heavy rain",
    66: "Light freezing rain",
    67: "Heavy freezing rain",
    71: "Slight snow fall",
    73: "Moderate snow fall",
    75: "Heavy snow fall",
    77: "Snow grains",
    80: "Slight rain showers",
    81: "Moderate rain showers",
    82: "Violent rain showers",
    85: "Slight snow showers",
    86: "Heavy snow showers",
    95: "Thunderstorm",
    96: "Thunderstorm with slight hail",
    99: "Thunderstorm with heavy hail",
}

# source, most hours since the last fetch, most hours since the last data hour (None: not checked)
SOURCE_SLA_HOURS = [
    ("EIA-region", 3.0, 3.0),
    ("EIA-fuel", 3.0, 30.0),
    ("EIA-interchange", 3.0, 54.0),
    ("ENTSOE-load", 3.0, 6.0),
    ("ENTSOE-gen", 3.0, 6.0),
    ("NOAA", 0.75, None),
    ("OpenMeteo", 0.75, None),
]
DEFAULT_SLA_HOURS = (3.0, None)

# Texts of the report that its readers match.
NEVER_FETCHED = "never fetched"
FETCH_TOO_OLD = "no successful fetch in %.1fh (SLA %.0fh)"
DATA_TOO_OLD = "data %.1fh old (SLA %.0fh)"
FRESH_SOURCES = "%d of %d sources fresh"
DEMAND_COUNTS = "%d demand observations, %d null, %d non-positive"
NOTHING_SETTLED = "awaiting settled data (feeds still backfilling)"
ALL_RECONCILE = "all %d BAs reconcile"
SOME_RECONCILE = "%d of %d BAs reconcile; %d flagged"

#: Stands for null in surrogate keys.
NULL_KEY_TEXT = "_dbt_utils_surrogate_key_null_"

# --- end of fixed values ----------------------------------------------------------------------
