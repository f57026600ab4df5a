"""Tables of match logs: fixed schemas, CSV with `\\N` for null, Parquet, incremental files, and checkpoints."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column types of the match tables (l long, s short, i int, d double, b boolean, t string).
_TABLES = {
    "games": "id:l demo_file:t demo_tick_rate:d game_tick_rate:d map_name:t game_type:l",
    "players": "id:l game_id:l name:t steam_id:l",
    "rounds": "id:l game_id:l start_tick:l end_tick:l warmup:b freeze_time_end:l round_number:s round_end_reason:s winner:s t_wins:s ct_wins:s",
    "ticks": "id:l round_id:l game_time:l demo_tick_number:l game_tick_number:l bomb_carrier:l bomb_x:d bomb_y:d bomb_z:d",
    "spotted": "id:l tick_id:l spotted_player:l spotter_player:l is_spotted:b",
    "footstep": "id:l tick_id:l stepping_player:l",
    "weapon_fire": "id:l tick_id:l shooter:l weapon:s",
    "hurt": "id:l tick_id:l victim:l attacker:l weapon:s armor_damage:i armor:i health_damage:i health:i hit_group:l",
    "grenades": "id:l thrower:l grenade_type:s throw_tick:l active_tick:l expired_tick:l destroy_tick:l",
    "grenade_trajectories": "id:l grenade_id:l id_per_grenade:i pos_x:d pos_y:d pos_z:d",
    "flashed": "id:l tick_id:l grenade_id:l thrower:l victim:l",
    "kills": "id:l tick_id:l killer:l victim:l weapon:s assister:l is_headshot:b is_wallbang:b penetrated_objects:i",
    "plants": "id:l start_tick:l end_tick:l planter:l succesful:b",
    "defusals": "id:l plant_id:l start_tick:l end_tick:l defuser:l succesful:b",
    "explosions": "id:l plant_id:l tick_id:l",
    "say": "id:l game_id:l tick_id:l message:t",
    "player_at_tick": "id:l player_id:l tick_id:l pos_x:d pos_y:d pos_z:d eye_pos_z:d vel_x:d vel_y:d vel_z:d view_x:d view_y:d aim_punch_x:d aim_punch_y:d view_punch_x:d view_punch_y:d team:s health:d armor:d"
    " has_helmet:b is_alive:b is_crouching:b is_walking:b is_scoped:b is_airborne:b remaining_flash_time:d active_weapon:s primary_weapon:s primary_bullets_clip:s primary_bullets_reserve:s secondary_weapon:s"
    " secondary_bullets_clip:s secondary_bullets_reserve:s num_he:s num_flash:s num_smoke:s num_molotov:s num_incendiary:s num_decoy:s num_zeus:s has_defuser:b has_bomb:b money:i ping:i",
    "visibilities": "spotter:t spotted:t start_game_tick:l end_game_tick:l spotter_id:l spotted_id:l demo:t hacking:i start_frame_num:l end_frame_num:l color:t",
    "visibilities_unadjusted": "spotter:t spotted:t start_game_tick:l end_game_tick:l spotter_id:l spotted_id:l demo:t hacking:i start_frame_num:l end_frame_num:l color:t",
    "hand_visibility": "index:l spotter:t spotted:t start_game_tick:l end_game_tick:l spotter_id:l spotted_id:l demo:t hacking:b",
    "lookers": "index:l tick_id:l looker_pat_id:l looker_player_id:l looked_at_pat_id:l looked_at_player_id:l",
    "actions": "action_name:t action_number:l game_tick_number:l demo:t player:t",
    "cover_origins": "index:l x:d y:d z:d",
    "cover_edges": "index:l origin_id:l cluster_id:l minX:d minY:d minZ:d maxX:d maxY:d maxZ:d",
    "nearest_origin": "index:l tick_id:l pat_id:l player_id:l origin_id:l",
    "player_in_cover_edge": "index:l tick_id:l looker_pat_id:l looker_player_id:l looked_at_pat_id:l looked_at_player_id:l nearest_origin_id:l cover_edge_id:l",
    "team_looking_at_cover_edge_cluster": "index:l tick_id:l origin_pat_id:l origin_player_id:l looking_pat_id:l looking_player_id:l nearest_origin_id:l cover_edge_cluster_id:l",
}
_TYPES = {"l": T.LongType(), "s": T.ShortType(), "i": T.IntegerType(), "d": T.DoubleType(), "b": T.BooleanType(), "t": T.StringType()}


def schema(name: str) -> T.StructType:
    return T.StructType([T.StructField(c, _TYPES[t]) for c, t in (x.split(":") for x in _TABLES[name].split())])


def table_names() -> list[str]:
    return list(_TABLES)


def read_table(spark: SparkSession, path: str, name: str, header: bool = True, null: str = r"\N") -> DataFrame:
    """A CSV file or folder with the fixed schema of a table; 0 and 1 are booleans. `_file` tells each row's file."""
    want = schema(name)
    raw = T.StructType([T.StructField(f.name, T.IntegerType() if isinstance(f.dataType, T.BooleanType) else f.dataType) for f in want])
    rows = spark.read.schema(raw).option("nullValue", null).option("header", header).csv(path)
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in want], F.col("_metadata.file_name").alias("_file"))


def save_tables(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_tables(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def read_columns(spark: SparkSession, path: str, columns: Sequence[str], where: Column | None = None) -> DataFrame:
    """Named columns of a Parquet table, with a filter that reaches the scan."""
    df = spark.read.parquet(path)
    return (df if where is None else df.where(where)).select(*columns)


def read_new_files(spark: SparkSession, folder: str, out: str, checkpoint: str, name: str) -> None:
    """Files of a CSV folder not seen before, appended to a Parquet table; the checkpoint is the ledger."""
    stream = spark.readStream.schema(schema(name)).option("nullValue", r"\N").option("header", True).csv(folder)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def write_csv(df: DataFrame, path: str, keys: Sequence[str], others: Sequence[str]) -> None:
    """Keys first, then the other columns, with a header."""
    df.select(*keys, *others).write.mode("overwrite").option("header", True).option("nullValue", r"\N").csv(path)


def append_ledger(summary: DataFrame, path: str, batch: str) -> None:
    """One more row about a batch."""
    summary.withColumn("batch", F.lit(batch)).write.mode("append").parquet(path)


def result_by_key(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.where(F.col(key) == value)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode a temporary one where none is
    set."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        named = context.getCheckpointDir()
    return re.sub(r"^file:/(?!/)", "file:///", named).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage, through a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
