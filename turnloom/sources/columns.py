"""Columns of the tables that are handed on as files."""

# Columns of the tables that are handed on.
SMILE_TURNS = (
    "patient_id", "therapist_id", "turn_index", "sentiment", "start_s", "end_s",
    "client_smile_intensity", "therapist_smile_intensity", "client_smile_freq", "therapist_smile_freq",
)
SYNC_TURNS = (
    "participant_id", "interviewer_id", "turn_index", "sentiment", "duration_s", "n_frames", "level", "au",
    "cc_r", "peak_lag_s", "cc_r_peak", "simul_smile_frames", "simul_smile_n_frames", "simul_smile_freq",
)
