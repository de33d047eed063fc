"""Table schemas. Explicit, so that no read or pivot needs a pass to infer them."""

from pyspark.sql import types as T

STRING, INT, BIGINT = T.StringType(), T.IntegerType(), T.LongType()
FLOAT, DOUBLE, BINARY = T.FloatType(), T.DoubleType(), T.BinaryType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields.items()])


#: What Spark's binaryFile source yields; streaming reads must state it.
RAW_FILES = struct(path=STRING, modificationTime=T.TimestampType(), length=BIGINT, content=BINARY)

#: One decoded image per row, pixels row-major (x runs fastest).
FRAMES = struct(
    frame_id=STRING, height=INT, width=INT, pixels=T.ArrayType(FLOAT, True), status=STRING
)

STAMP = struct(stampData=BINARY)
ALERTS = struct(
    candid=BIGINT, alertId=BIGINT,
    cutoutScience=STAMP, cutoutTemplate=STAMP, cutoutDifference=STAMP,
)
CUTOUTS = struct(candid=BIGINT, kind=STRING, file_name=STRING, content=BINARY)

BRONZE = struct(
    file_path=STRING, object_id=STRING, image_type=STRING,
    median_bg=FLOAT, mean_sub=FLOAT, std_sub=FLOAT, bright_pixels=INT, status=STRING,
)
BRONZE_METRICS = ["median_bg", "mean_sub", "std_sub", "bright_pixels"]
IMAGE_TYPES = ["DIFFERENCE", "SCIENCE", "TEMPLATE"]

POSITION = struct(x=DOUBLE, y=DOUBLE)
PHOTOMETRY = struct(
    flux_total=DOUBLE, flux_peak=DOUBLE, area_pixels=DOUBLE, magnitude_estimate=DOUBLE, snr=DOUBLE
)
DETECTIONS = struct(
    file_path=STRING, telescope_id=STRING, observation_time=STRING, image_type=STRING,
    total_objects=INT, bright_sources=INT, faint_sources=INT,
    background_level=FLOAT, background_noise=FLOAT, dynamic_range=FLOAT, saturation_fraction=FLOAT,
    source_positions=T.ArrayType(POSITION), photometry_data=T.ArrayType(PHOTOMETRY),
    quality_score=FLOAT, processing_status=STRING,
)

#: exposure_id is a bigint: a ten-digit run does not fit an int.
CATALOG = struct(
    file_path=STRING, telescope=STRING, data_type=STRING, observation_date=STRING,
    field_id=INT, detector_id=INT, filter_band=STRING, exposure_id=BIGINT,
    file_size_mb=FLOAT, processing_timestamp=STRING, quality_flags=STRING,
)

BENCHMARK_RUNS = struct(
    benchmark_type=STRING, data_path=STRING,
    configuration=struct(partitions=INT, memory=STRING, cores=INT),
    num_files=BIGINT, execution_time=DOUBLE, throughput_files_per_sec=DOUBLE,
    num_partitions_used=INT,
    analysis_results=struct(
        total_files=BIGINT, avg_background=DOUBLE, avg_noise=DOUBLE, brightest_pixel=DOUBLE,
        total_bright_objects=BIGINT, avg_objects_per_image=DOUBLE, avg_snr=DOUBLE,
        avg_object_density=DOUBLE, avg_quality_score=DOUBLE,
    ),
)


def with_fields(schema: T.StructType, **fields: T.DataType) -> T.StructType:
    """``schema`` with more columns behind its own."""
    return T.StructType([*schema.fields, *(T.StructField(n, t) for n, t in fields.items())])
