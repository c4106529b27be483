"""Fixed values that results depend on.

These are the analysis parameters of the road-congestion jobs. They are plain
defaults: every public function takes them as arguments.
"""

# --- fixed values (must stay equal for equal results) -----------------------
# Congestion classes: thresholds on (vFreeflowMin - averageSpeed), km/h.
CONGESTION_THRESHOLDS = (0.0, 5.0, 10.0, 15.0, 20.0, 25.0, 30.0, 35.0, 40.0, 45.0, 50.0)
# An edge is congested from this class upwards.
CONGESTION_CLASS_THRESHOLD = 5
# DenGraph: neighbourhood radius on the distance scale, and the minimum
# neighbourhood size of a core vertex.
DENGRAPH_EPSILON = 0.035
DENGRAPH_ETA = 2
# DenGraph: measurement field used as edge weight.
DENGRAPH_WEIGHT_FIELD = "density"
# Vertex types of the density clustering, and the cluster id of noise.
CORE = "CORE"
BORDER = "BORDER"
NOISE = "NOISE"
NOISE_CLUSTER_ID = -1
# Streaming: watermark delay and the grace after an event time before it is final.
WATERMARK_DELAY = "0 seconds"
FINAL_GRACE = "30 seconds"
# Message-bus topics of the two jobs.
CC_TOPIC = "congested_components_cclass_threshold_5_results"
DENGRAPH_TOPIC = "dengraph_results"
# ---------------------------------------------------------------------------

# Timestamp layout inside the JSON value of the key/value output.
JSON_TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS"
