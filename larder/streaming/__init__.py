from larder.streaming.jobs import (cart_state_stream, chat_sessions_stream, checkpoint_location, event_windows,
                                   index_updates_writer, latest_collection, order_notifications)

__all__ = ["cart_state_stream", "chat_sessions_stream", "checkpoint_location", "event_windows",
           "index_updates_writer", "latest_collection", "order_notifications"]
