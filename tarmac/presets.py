"""Fixed values of the road-safety domain. Operators take them as defaults; all are parameters."""

from __future__ import annotations

# ---- Fixed values: labels, domains and bounds ------------------------------------------------
LABELS = ["Fatal", "Serious", "Slight"]
LABEL_CODES = {"Slight": 0, "Serious": 1, "Fatal": 2}
CODE_LABELS = {"0": "Slight", "1": "Serious", "2": "Fatal"}
SEVERE_LABELS = ["Fatal", "Serious"]
SEVERITY_WEIGHTS = {"Slight": 1.0, "Serious": 2.0, "Fatal": 3.0}
SEVERITY_CODE_WEIGHTS = {"Slight": 0.0, "Serious": 1.0, "Fatal": 2.0}
SEVERITY_DOMAIN = ["Slight", "Serious", "Fatal", "1", "2", "3"]
SPEED_LIMITS = [20, 30, 40, 50, 60, 70]
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
SEX_DOMAIN = ["Male", "Female"]
LATITUDE_BOUNDS = (49.0, 61.0)
LONGITUDE_BOUNDS = (-8.0, 2.0)
GENERIC_LONGITUDE_BOUNDS = (-11.0, 2.0)
FIRST_YEAR = "2005-01-01"
MAX_CASUALTIES = 50
TIME_PATTERN = r"^\d{1,2}:\d{2}$"
# Blanks around the dash are allowed: published data writes "26 - 35".
AGE_BAND_PATTERN = r"^\d+\s*-\s*\d+$|^Over 75$"
STRICT_AGE_BAND_PATTERN = r"^\d+-\d+$"
SENTINEL = "Data missing or out of range"
SEX_CODES = ["Male", "Female", "Not known", "M", "F", "1", "2", "3"]
SEX_ALIASES = {"M": "Male", "F": "Female", "1": "Male", "2": "Female", "3": "Not known"}

WEATHER_COLUMNS = ["temp", "tmin", "tmax", "prcp", "snwd", "wspd", "pres", "rhum", "wpgt", "tsun", "cldc"]
WEATHER_KEEP = ["time", *WEATHER_COLUMNS]
WEATHER_BOUNDS = {
    "temp": (-30.0, 50.0),
    "tmin": (-30.0, 45.0),
    "tmax": (-25.0, 50.0),
    "prcp": (0.0, 10000.0),
    "snwd": (0.0, 2000.0),
    "wspd": (0.0, 114.0),
    "pres": (870.0, 1085.0),
    "rhum": (0.0, 100.0),
    "wpgt": (0.0, 114.0),
    "tsun": (0.0, 1440.0),
    "cldc": (0.0, 9.0),
}

# ---- Fixed values: column lists ---------------------------------------------------------------
SPARSE_COLUMNS = [
    "Carriageway_Hazards",
    "Special_Conditions_at_Site",
    "Hit_Object_in_Carriageway",
    "Hit_Object_off_Carriageway",
    "Skidding_and_Overturning",
    "X2nd_Road_Class",
    "Driver_IMD_Decile",
]
REQUIRED_COLUMNS = ["Latitude", "Longitude", "Speed_limit", "Accident_Index"]
CRITICAL_COLUMNS = [
    "Accident_Index",
    "Vehicle_Reference",
    "Accident_Severity",
    "Latitude",
    "Longitude",
    "Date",
    "Time",
]
UNWANTED_COLUMNS = [
    "Accident_Index",
    "Year_x",
    "Location_Easting_OSGR",
    "Location_Northing_OSGR",
    "X1st_Road_Number",
    "X2nd_Road_Number",
    "LSOA_of_Accident_Location",
    "model",
    "InScotland",
    "Police_Force",
    "Was_Vehicle_Left_Hand_Drive",
    "Vehicle_Leaving_Carriageway",
    "Number_of_Casualties",
]
UNWANTED_SPARSE_COLUMNS = [
    "X2nd_Road_Class",
    "Carriageway_Hazards",
    "Special_Conditions_at_Site",
    "Driver_IMD_Decile",
    "Hit_Object_in_Carriageway",
    "Hit_Object_off_Carriageway",
    "Skidding_and_Overturning",
    "time",
    "Year_y",
    "Did_Police_Officer_Attend_Scene_of_Accident",
]
LEAKAGE_COLUMNS = ["Number_of_Casualties", "Did_Police_Officer_Attend_Scene_of_Accident"]
ID_COLUMNS = ["Accident_Index", "Vehicle_Index", "Casualty_Index", "Accident_Severity"]

# ---- Fixed values: category codes -------------------------------------------------------------
ROAD_TYPE_CODES = {
    "Single carriageway": 1,
    "Dual carriageway": 2,
    "Roundabout": 0,
    "One way street": 1,
    "Slip road": 2,
    "Unknown": 1,
}
ROAD_RISK_MULTIPLIERS = {
    "Single carriageway": 1.5,
    "Dual carriageway": 1.0,
    "Roundabout": 0.8,
    "One way street": 0.9,
    "One-way street": 0.9,
    "Slip road": 0.7,
}
ROAD_SPEED_MULTIPLIERS = {"Single carriageway": 1.0, "Dual carriageway": 1.5, "Roundabout": 0.8}
SPEED_RISK = {20: 1, 30: 2, 40: 3, 50: 4, 60: 5, 70: 6}
VEHICLE_TYPE_CODES = {
    "Car": 0,
    "Taxi/Private hire car": 0,
    "Motorcycle over 500cc": 5,
    "Motorcycle 125cc and under": 5,
    "Motorcycle 50cc and under": 5,
    "Motorcycle over 125cc and up to 500cc": 5,
    "Motorcycle - unknown cc": 5,
    "Electric motorcycle": 5,
    "Van / Goods 3.5 tonnes mgw or under": 2,
    "Goods over 3.5t. and under 7.5t": 2,
    "Goods 7.5 tonnes mgw and over": 3,
    "Goods vehicle - unknown weight": 3,
    "Bus or coach (17 or more pass seats)": 1,
    "Minibus (8 - 16 passenger seats)": 1,
    "Agricultural vehicle": 4,
    "Other vehicle": 4,
}
IMPACT_CODES = {
    "Data missing or out of range": -1,
    "Did not impact": 0,
    "Back": 1,
    "Front": 2,
    "Nearside": 3,
    "Offside": 4,
}
TOWING_CODES = {
    "No tow/articulation": 0,
    "Caravan": 1,
    "Other tow": 1,
    "Single trailer": 1,
    "Double or multiple trailer": 1,
    "Articulated vehicle": 1,
    "Data missing or out of range": 0,
}
ENGINE_EDGES = [0.0, 1400.0, 2000.0, 4000.0, float("inf")]
AGE_MIDPOINTS = {
    "0 - 5": 2.5,
    "6 - 10": 8.0,
    "11 - 15": 13.0,
    "16 - 20": 18.0,
    "21 - 25": 23.0,
    "26 - 35": 30.0,
    "36 - 45": 40.0,
    "46 - 55": 50.0,
    "56 - 65": 60.0,
    "66 - 75": 70.0,
    "Over 75": 80.0,
}
DEFAULT_AGE = 30.0
SEX_FLAG = {"Male": 1, "Female": 0, "Not known": 1, "Data missing or out of range": 1}
HOME_AREA_CODES = {"Urban area": 0, "Small town": 1, "Rural": 2, "Data missing or out of range": -1}
MANOEUVRE_GROUPS = {
    "Going ahead other": "going_ahead",
    "Going ahead right-hand bend": "going_ahead",
    "Going ahead left-hand bend": "going_ahead",
    "Turning right": "turning",
    "Turning left": "turning",
    "U-turn": "turning",
    "Waiting to go - held up": "stationary",
    "Waiting to turn right": "stationary",
    "Waiting to turn left": "stationary",
    "Parked": "stationary",
    "Slowing or stopping": "stationary",
    "Overtaking moving vehicle - offside": "overtaking",
    "Overtaking static vehicle - offside": "overtaking",
    "Overtaking - nearside": "overtaking",
    "Changing lane to right": "lane_change",
    "Changing lane to left": "lane_change",
    "Moving off": "other",
    "Reversing": "other",
    "Data missing or out of range": "unknown",
}
MANOEUVRE_GROUP_CODES = {
    "going_ahead": 0,
    "stationary": 1,
    "turning": 2,
    "lane_change": 3,
    "other": 4,
    "overtaking": 5,
    "unknown": -1,
}
JUNCTION_LOCATION_CODES = {
    "Not at or within 20 metres of junction": 0,
    "Cleared junction or waiting/parked at junction exit": 1,
    "Entering from slip road": 2,
    "Leaving roundabout": 2,
    "Entering roundabout": 3,
    "Leaving main road": 3,
    "Entering main road": 3,
    "Mid Junction - on roundabout or on main road": 4,
    "Approaching junction or waiting/parked at junction approach": 5,
    "Data missing or out of range": -1,
}
JUNCTION_CONTROL_CODES = {
    "Not at junction or within 20 metres": 0,
    "Authorised person": 1,
    "Stop sign": 2,
    "Auto traffic signal": 3,
    "Give way or uncontrolled": 4,
    "Data missing or out of range": -1,
}
JUNCTION_DETAIL_CODES = {
    "Not at junction or within 20 metres": 0,
    "Slip road": 1,
    "Mini-roundabout": 2,
    "Roundabout": 2,
    "Private drive or entrance": 3,
    "T or staggered junction": 4,
    "Other junction": 4,
    "Crossroads": 5,
    "More than 4 arms (not roundabout)": 6,
    "Data missing or out of range": -1,
}
JOURNEY_CODES = {
    "Commuting to/from work": 0,
    "Taking pupil to/from school": 0,
    "Pupil riding to/from school": 0,
    "Other": 1,
    "Not known": 1,
    "Other/Not known (2005-10)": 1,
    "Journey as part of work": 2,
    "Data missing or out of range": -1,
}
ROAD_CLASS_CODES = {"M": 0, "A": 1, "D": 2, "B": 3, "C": 4, "Unclassified": 5}

# ---- Fixed values: costs, targets and threshold grids -----------------------------------------
# cost[true label][predicted label]
MISCLASSIFICATION_COST = {
    "Fatal": {"Fatal": 0, "Serious": 20, "Slight": 100},
    "Serious": {"Fatal": 5, "Serious": 0, "Slight": 15},
    "Slight": {"Fatal": 2, "Serious": 1, "Slight": 0},
}
SMOTE_TARGETS = {"Fatal": 150_000, "Serious": 450_000}
UNDERSAMPLE_TARGETS = {"0": 400_000, "1": 100_542, "2": 9_790}
MIN_RARE_PERCENT = 5.0
DEFAULT_THRESHOLD = 0.33


def steps(start: float, step: float, count: int) -> list[float]:
    return [round(start + step * i, 10) for i in range(count)]


def training_grid() -> list[tuple[float, float, float]]:
    """Thresholds for (Fatal, Serious, Slight) searched after training."""
    return [
        (a, b, c) for a in steps(0.02, 0.05, 10) for b in steps(0.05, 0.05, 10) for c in steps(0.10, 0.10, 7)
    ]


def tuning_grid() -> list[tuple[float, float, float]]:
    """Thresholds searched inside a tuning trial."""
    return [
        (a, b, c) for a in steps(0.05, 0.05, 10) for b in steps(0.10, 0.05, 10) for c in steps(0.20, 0.10, 7)
    ]

# ---- Fixed values: search spaces of the tuned boosted trees --
BOOSTED_SPACE = {
    "depth": [4, 6, 8, 10],
    "step": (0.01, 0.15, "log"),
    "iterations": [500, 1000, 2000, 3000],
    "l2": (1.0, 30.0, "log"),
    "min_leaf": [1, 5, 10, 20, 50],
    "fatal_weight": (5.0, 60.0, "linear"),
    "serious_weight": (1.5, 10.0, "linear"),
}
# Trees of 15 to 255 leaves are 4 to 8 levels deep.
SAMPLED_SPACE = {
    "depth": (4, 8, "int"),
    "step": (0.005, 0.15, "log"),
    "iterations": [500, 1000, 2000, 3000],
    "l2": (1e-3, 10.0, "log"),
    "min_leaf": (5, 100, "int"),
    "subsample": (0.5, 1.0, "linear"),
    "feature_share": (0.5, 1.0, "linear"),
    "fatal_weight": (5.0, 80.0, "linear"),
    "serious_weight": (1.5, 10.0, "linear"),
}
