"""Schemas of stored records."""

from __future__ import annotations

L0 = "sessionKey string, sessionId string, recordedAt string, id string, role string, content string, timestamp long"
L1 = (
    "id string, content string, type string, priority int, scene_name string, source_message_ids array<string>, "
    "metadata struct<activity_start_time:string,activity_end_time:string>, timestamps array<string>, createdAt string, updatedAt string, sessionKey string, sessionId string"
)
MESSAGE = "struct<role:string,content:string,timestamp:string>"
SESSIONS = f"array<struct<sessionKey:string,sessionId:string,conversations:array<array<{MESSAGE}>>>>"
ENTRY = "timestamp string, node_id string, tool_call string, summary string, result_ref string, tool_call_id string, session_key string, score int, offloaded string"
SCENES = "array<struct<scene_name:string,message_ids:array<string>,memories:array<struct<content:string,type:string,priority:int,source_message_ids:array<string>>>>>"
DECISIONS = "array<struct<record_id:string,action:string,target_ids:array<string>,merged_content:string,merged_type:string,merged_priority:int,merged_timestamps:array<string>>>"
SUMMARIES = "array<struct<tool_call_id:string,summary:string,score:int>>"
