"""Fixed values of the metadata rules: word lists, patterns and lookup tables."""

# Roles a name, unit, device class or domain speaks for, in order of precedence.
NAME_HINTS = [
    (r"bed|mattress|sleep_sensor|slaap|matras", "bed"),
    (r"presence|occupancy|motion|mmwave|pir|radar|beweging|aanwezig|human_present|ld2410|fp2", "presence"),
    (r"power|vermogen|wattage|consumption|verbruik|_watts?|kwh|energie|\benergy\b|stopcontact|smartplug|stekker", "power"),
    (r"focus|do_not_disturb|dnd|niet_storen", "focus"),
    (r"steps|stappen|schritte", "steps"),
    (r"alarm|wecker|wekker|wake_?up|alarmtijd", "alarm_time"),
    (r"door|window|opening|contact|deur|raam|magnet|reed", "door"),
    (r"co2|pm1|pm2|pm10|voc|tvoc|nox|no2|aqi|air_?quality|luchtkwaliteit|humidity|vochtigheid|temperature|temperatuur|lux|illuminance|light_?level|lichtsterkte|brightness", "env"),
    (r"connected_devices|devices_connected|online_devices|device_count|num_clients|clients_total|network_clients", "custom"),
    (r"distance|proximity|afstand|nearest", "custom"),
]
UNIT_ROLES = {
    "W": "power", "kW": "power", "mW": "power", "Wh": "power", "kWh": "power", "A": "power", "mA": "power",
    "ppm": "env", "ppb": "env", "µg/m³": "env", "g/m³": "env", "°C": "env", "°F": "env", "%": "env", "lx": "env", "klx": "env", "dB": "env",
    "steps": "steps", "V": "custom",
}
DEVICE_CLASS_ROLES = {
    "occupancy": "presence", "motion": "presence", "presence": "presence", "moving": "presence", "vibration": "presence",
    "door": "door", "window": "door", "garage_door": "door", "opening": "door",
    "power": "power", "energy": "power", "current": "power", "apparent_power": "power", "reactive_power": "power", "outlet": "power",
    "battery": "battery", "temperature": "env", "humidity": "env", "carbon_dioxide": "env", "carbon_monoxide": "env", "illuminance": "env",
    "pm1": "env", "pm10": "env", "pm25": "env", "nitrogen_dioxide": "env", "ozone": "env", "volatile_organic_compounds": "env", "aqi": "env",
    "timestamp": "alarm_time",
}
DOMAIN_ROLES = {"light": "light", "media_player": "media", "person": "person", "input_datetime": "alarm_time"}
NOT_A_TRACKER = r"distance|proximity|afstand|nearest|_km\b|_mi\b|_miles?\b|_meters?\b|_metres?\b"
BLOCKLIST = (
    r"rssi|lqi|signal_quality|signal_strength|packet_loss|ping|uptime|cpu|memory|processor|supervisor|core_|watchman|last_updated|last_parse|"
    r"_[1-5]d\b|forecast|regenkans|zonkans|next_dawn|next_dusk|next_noon|next_rising|next_setting|battery_plus|daily_energy|spanning|"
    r"print_progress|firmware|update_available|last_response|failed_pings|_slope$|_ema_|preset_|regulated_|"
    r"\bhar_|strava|identify|identificeren|trigger_level|trigger_pressure|occupied_pressure|unoccupied_pressure|calibrate|opstartgedrag|"
    r"power_on_level|power_on_behavior|niveau_bij_opstarten|wake_word|start_up_color|tts_volume|print_bed|nozzle|heatbreak|cooling_fan|"
    r"zigbee|coordinator|slzb|zbdongle|conbee|_chip_|chip_temp|mcu|soc_temp|board_temp|radio_temp|die_temp|internal_temp|node_temp|esp_temp"
)
BLOCKED_CLASSES = ["signal_strength", "timestamp", "update", "data_size", "data_rate", "duration", "monetary"]
NEVER_DOMAINS = ["button", "scene", "script", "update", "automation", "camera", "remote", "zone", "tts", "persistent_notification"]
STATE_DOMAINS = [
    "sensor", "binary_sensor", "input_boolean", "input_number", "switch", "light", "media_player", "lock", "cover", "number",
    "select", "input_datetime", "person", "device_tracker", "alarm_control_panel", "input_select", "climate", "fan",
]
ROLE_DOMAINS = {
    "presence": ["binary_sensor", "sensor", "input_boolean"],
    "bed": ["binary_sensor", "sensor", "input_boolean", "switch"],
    "power": ["sensor", "switch"],
    "light": ["light", "switch"],
    "media": ["media_player"],
    "env": ["sensor"],
    "person": ["person", "device_tracker"],
    "focus": ["binary_sensor", "switch", "input_boolean"],
    "alarm_time": ["input_datetime", "sensor", "input_boolean"],
    "door": ["binary_sensor", "lock", "cover", "input_boolean"],
    "steps": ["sensor"],
    "battery": ["sensor"],
    "custom": ["sensor", "binary_sensor", "input_boolean", "input_number", "switch", "light", "media_player"],
}
OWN_SUFFIXES = ["_activity", "_confidence", "_questions", "_override", "_accuracy"]

# Integrations and devices that do, or do not, describe a home.
INTEGRATION_SKIP = [
    "met", "metno", "openweathermap", "accuweather", "pirateweather", "forecast_solar", "sun", "moon", "backup", "hacs", "update",
    "system_health", "systemmonitor", "cloud", "google_translate", "tts", "radio_browser", "season", "workday", "uptime", "version",
    "homeassistant", "hassio", "supervisor", "waze_travel_time",
]
INTEGRATION_KEEP = [
    "zwave_js", "zha", "zigbee2mqtt", "matter", "mobile_app", "esphome", "hue", "deconz", "shelly", "tasmota", "sonoff", "tuya",
    "xiaomi_miio", "homekit_controller", "insteon", "fritzbox", "unifi",
]
DEVICE_INFRA = r"coordinator|bridge|\bhub\b|gateway|border\s*router|\brouter\b|dongle|conbee|zbdongle|slzb|skyconnect|zbbridge|zwave.?stick"

# Direct-signal test of an unbound entity.
DIRECT_DOMAINS = ["switch", "binary_sensor", "sensor", "media_player", "light"]
ACTUATOR_DOMAINS = ["switch", "light", "media_player", "climate", "fan", "vacuum", "lock", "cover", "humidifier", "water_heater"]
ACTION_WORDS = r"power|watt|current|amper|verbruik|running|active|bezig|in_use|door|deur|motion|beweg|occup|presence|aanwezig|open|button|knop"
DIAGNOSTIC_WORDS = r"offline|online|since|uptime|rssi|signal|firmware|update|connect|link"
AMBIENT_WORDS = r"temp|humid|vocht|lucht|co2|pressure|druk|lux|illum|bright|helder|luminance|fan"
APPLIANCE_WORDS = (
    r"coffee|koffie|oven|stove|kook|wash|wasmachine|dryer|droger|dish|vaatwas|printer|fridge|koelkast|freezer|vriezer|kettle|"
    r"waterkoker|airfryer|machine|boiler|tv\b|television"
)

# Category of each role, and whether a category is kept by default.
ROLE_CATEGORY = {
    "presence": "presence", "person": "presence", "bed": "sleep", "light": "lights", "media": "media", "door": "doors", "env": "climate",
    "power": "power", "focus": "phone", "steps": "phone", "alarm_time": "phone", "battery": "diagnostics", "custom": "other",
}
RELEVANT_CATEGORIES = ["presence", "sleep", "lights", "media", "doors", "climate", "power", "phone"]

# Trust tier of each role: 1 direct, 2 behavioural, 3 ambient.
ROLE_TIER = {
    "bed": 1, "presence": 1, "person": 1, "media": 1, "door": 1, "focus": 1, "alarm_time": 1,
    "power": 2, "light": 2, "steps": 2, "custom": 2, "env": 3, "battery": 3,
}
PERSONAL_ROLES = ["alarm_time", "focus", "steps", "battery"]

# Reserved activities: exact words, and single words that are enough on their own.
RESERVED_SYNONYMS = {
    "away": ["away", "out", "gone", "absent", "outside", "not home", "not in", "out of the house", "away from home", "out and about", "left the house", "not at home", "out of home"],
    "asleep": ["asleep", "sleeping", "sleep", "napping", "nap", "in bed", "asleep in bed"],
    "home": ["home", "at home", "in the house", "back home", "present", "indoors"],
}
RESERVED_TOKENS = {
    "away": ["away", "out", "gone", "absent", "outside"],
    "asleep": ["asleep", "sleeping", "sleep", "napping", "nap"],
    "home": [],
}
FINE_UNDER_HOME = ["cooking", "eating", "movie", "working", "chilling"]

# Phrase of a feature above and below its usual level.
PHRASES = {
    ("presence", "frac"): ("active in {place}", "quiet in {place}"),
    ("presence", "any"): ("movement in {place}", "no movement in {place}"),
    ("presence", "transitions"): ("in and out of {place}", "settled in {place}"),
    ("bed", "occupied"): ("in bed", "bed empty"),
    ("bed", "mean"): ("in bed", "bed empty"),
    ("bed", "max"): ("in bed", "bed empty"),
    ("power", "on"): ("{place} in use", "{place} idle"),
    ("power", "max_w"): ("{place} drawing power", "{place} idle"),
    ("light", "on_frac"): ("{place} lights on", "{place} lights off"),
    ("light", "on_last"): ("{place} lights on", "{place} lights off"),
    ("media", "playing"): ("media playing in {place}", "media off in {place}"),
    ("media", "active"): ("media on in {place}", "media off in {place}"),
    ("media", "paused"): ("media paused in {place}", "media not paused"),
    ("env", "mean"): ("{place} {metric} higher", "{place} {metric} lower"),
    ("env", "max"): ("{place} {metric} higher", "{place} {metric} lower"),
    ("env", "delta"): ("{place} {metric} rising", "{place} {metric} falling"),
    ("person", "home_frac"): ("{who} home", "{who} away"),
    ("person", "home_last"): ("{who} home", "{who} away"),
    ("focus", "on_last"): ("{who}'s phone in focus/Do-Not-Disturb", "{who}'s phone active"),
    ("alarm_time", "minutes_until"): ("alarm a while off", "alarm coming up soon"),
    ("alarm_time", "imminent"): ("alarm imminent", "no alarm imminent"),
    ("door", "opened_any"): ("{place} door opened", "{place} door shut"),
    ("door", "open_count"): ("{place} door busy", "{place} door quiet"),
    ("steps", "delta"): ("lots of steps ({who})", "few steps ({who})"),
    ("battery", "delta"): ("{place} charging", "{place} battery steady"),
    ("custom", "mean"): ("{place} high", "{place} low"),
    ("custom", "max"): ("{place} high", "{place} low"),
    ("custom", "delta"): ("{place} rising", "{place} falling"),
}

# Named transforms: information tiers, input kind, parameters, part of the conservative set.
TRANSFORMS = {
    "occupancy_fraction": (["T1"], "entity", {}, True),
    "any_active": (["T1"], "entity", {}, True),
    "transition_count": (["T1", "T2"], "entity", {}, True),
    "run_length_on": (["T1"], "entity", {}, False),
    "time_since_last_change": (["T1", "T2", "T5"], "entity", {"cap_min": "int"}, False),
    "state_onehot": (["T2"], "entity", {"states": "list[str]"}, False),
    "state_dwell_fraction": (["T2"], "entity", {"state": "str"}, False),
    "last_state": (["T2", "T5"], "entity", {}, True),
    "window_mean": (["T3"], "entity", {}, True),
    "window_max": (["T3"], "entity", {}, True),
    "window_minimum": (["T3"], "entity", {}, False),
    "window_delta": (["T3", "T4"], "entity", {}, True),
    "window_slope": (["T3"], "entity", {}, False),
    "deviation_from_daily_baseline": (["T3"], "entity", {"baseline_days": "int"}, False),
    "counter_rate": (["T4"], "entity", {}, False),
    "home_fraction": (["T5"], "entity", {}, True),
    "co_occurrence_and": (["COMPOSITE"], "feature", {"threshold": "float"}, True),
    "co_occurrence_count": (["COMPOSITE"], "feature", {}, False),
    "sequence_within": (["COMPOSITE"], "feature", {"max_gap_min": "int"}, False),
    "room_transition_count": (["COMPOSITE"], "feature", {"rooms": "list[str]"}, False),
    "absence_and": (["COMPOSITE"], "feature", {}, True),
}
FEATURE_NAME = r"^[a-z][a-z0-9_]{0,59}$"
FEATURE_SUFFIXES = [
    "frac", "any", "transitions", "mean", "max", "occupied", "on", "max_w", "on_last", "on_frac", "playing", "paused", "active",
    "delta", "home_last", "home_frac", "minutes_until", "imminent", "opened_any", "open_count",
]

# Words of room names that stand for an anchor without a sensor of its own.
ANCHOR_ROOMS = {
    "bed": "bed|bedroom|slaap",
    "door": r"\bhall\b|hallway|entr|entree|foyer|porch|voordeur",
}
