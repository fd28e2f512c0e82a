"""Schemas of tables that sources read."""

WAVEFORMS = "frame_id int, x int, y int, hist array<bigint>"
PEAK_LISTS = "frame_id int, x int, y int, peaks array<array<double>>"
POINTS = "cloud_id string, role string, point_id bigint, pos_x double, pos_y double, pos_z double, label int"
