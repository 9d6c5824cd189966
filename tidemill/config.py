"""Constants of the monitored line, as one frozen configuration.

``load`` reads a YAML or JSON file with the same keys; what it leaves out keeps its default.
"""

from __future__ import annotations

import copy
import hashlib
import json
from pathlib import Path

SENSORS = ("vibration_rms", "bearing_temp_c", "motor_current_a", "line_pressure_bar")

# Fixed values of the monitored line.
DEFAULT: dict = {
    "assets": {"FILLER": {"code": 1, "tag": "LINE_A.FILLER"}, "CAPPER": {"code": 2, "tag": "LINE_A.CAPPER"}, "LABELLER": {"code": 3, "tag": "LINE_A.LABELLER"}},
    "ranges": {"vibration_rms": [0, 100], "bearing_temp_c": [-50, 250], "motor_current_a": [0, 1000], "line_pressure_bar": [0, 100]},
    "splits": {
        "dev": {"start": "2023-09-04", "train": [901, 902, 903], "validation": [904], "test": [905, 906]},
        "locked": {"start": "2024-03-04", "train": list(range(101, 111)), "validation": list(range(201, 205)), "test": list(range(301, 307))},
    },
    "split_assets": {"train": ["FILLER", "CAPPER"], "validation": ["FILLER", "CAPPER"], "test": ["LABELLER", "FILLER"]},
    "nominal": {
        "FILLER": {"vibration_rms": 2.0, "bearing_temp_c": 48.0, "motor_current_a": 12.0, "line_pressure_bar": 4.0},
        "CAPPER": {"vibration_rms": 1.6, "bearing_temp_c": 44.0, "motor_current_a": 8.0, "line_pressure_bar": 3.2},
        "LABELLER": {"vibration_rms": 1.2, "bearing_temp_c": 40.0, "motor_current_a": 5.0, "line_pressure_bar": 2.4},
    },
    "sigma": {
        "FILLER": {"vibration_rms": 0.12, "bearing_temp_c": 0.25, "motor_current_a": 0.25, "line_pressure_bar": 0.05},
        "CAPPER": {"vibration_rms": 0.10, "bearing_temp_c": 0.25, "motor_current_a": 0.20, "line_pressure_bar": 0.04},
        "LABELLER": {"vibration_rms": 0.08, "bearing_temp_c": 0.20, "motor_current_a": 0.15, "line_pressure_bar": 0.03},
    },
    "phi": {"vibration_rms": 0.6, "bearing_temp_c": 0.98, "motor_current_a": 0.8, "line_pressure_bar": 0.5},
    "floor": {"vibration_rms": 0.15, "motor_current_a": 0.10, "line_pressure_bar": 0.20},
    "ambient_c": 25.0,
    "lag_tau_s": 900,
    # state, first second, end, speed at the first second, speed at the end
    "day": [
        ["STARTUP", 0, 1200, 0.0, 0.8],
        ["STEADY_80", 1200, 28800, 0.8, 0.8],
        ["SPEED_CHANGE", 28800, 29400, 0.8, 1.0],
        ["STEADY_100", 29400, 50400, 1.0, 1.0],
        ["STOPPING", 50400, 51000, 1.0, 0.0],
        ["PLANNED_STOP", 51000, 54600, 0.0, 0.0],
        ["RESTART", 54600, 55800, 0.0, 1.0],
        ["STEADY_100", 55800, 85800, 1.0, 1.0],
        ["SHUTDOWN", 85800, 86400, 1.0, 0.0],
    ],
    "change": {"split": "test", "kind": "product_changeover", "label": "NORMAL", "sensor": "motor_current_a", "relative_shift": 0.08, "start": 64800, "end": 86400},
    "jitter": 0.005,
    "warm_up_s": 1800,
    "tail_s": 600,
    # code, channel, sensor, quota (share of each asset's days, or one in so many asset-days), shortest and longest duration
    "faults": {
        "bearing_wear": ["BW", "equipment", "vibration_rms", ["share", 0.4], 7200, 7200],
        "overheating": ["OH", "equipment", "bearing_temp_c", ["one_in", 3], 1800, 1800],
        "pressure_spikes": ["PS", "equipment", "line_pressure_bar", ["one_in", 3], 600, 600],
        "stuck_sensor": ["SS", "data", "any", ["one_in", 4], 1200, 3600],
        "dropout": ["DO", "data", "all", ["one_in", 4], 120, 900],
    },
    "wear_sigma": [0.5, 3.0],
    "heat_c": [1.0, 6.0],
    "spikes": {"least": 3, "most": 5, "sigma": 4.0},
    "equipment_states": ["STEADY_80", "SPEED_CHANGE", "STEADY_100"],
    "stop_state": "PLANNED_STOP",
    "window_s": 10,
    "frames": {"5m": [300, 150], "30m": [1800, 900]},
    "iqr_epsilon": 1e-12,
    "gap_s": 60,
    "cap_per_hour": 1.0,
    "delay_quantiles": [0.5, 0.9],
    "static_k": [1, 2, 3, 4, 5, 6],
    "forest": {"trees": 200, "sample": 256, "seed": 7, "quantiles": [0.90, 0.95, 0.975, 0.99, 0.995, 0.999]},
    "monitoring": {"k": 3.0, "min_history": 30, "warm_up_windows": 180},
    "deny": ["fault", "event", "label", "split", "asset", "onset"],
}


def load(path: str | None = None) -> dict:
    """A copy of the defaults, updated from a file."""
    out = copy.deepcopy(DEFAULT)
    if path:
        text = Path(path).read_text()
        if path.endswith((".yaml", ".yml")):
            import yaml

            new = yaml.safe_load(text)
        else:
            new = json.loads(text)

        def merge(a: dict, b: dict) -> None:
            for k, v in b.items():
                if isinstance(v, dict) and isinstance(a.get(k), dict):
                    merge(a[k], v)
                else:
                    a[k] = v

        merge(out, new or {})
    return out


def fingerprint(cfg: dict) -> str:
    """sha256 of the configuration, for every report."""
    return hashlib.sha256(json.dumps(cfg, sort_keys=True).encode()).hexdigest()
