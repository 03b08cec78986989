"""Rule tables: phrases that are always wrong, and pairs of homophones with the words that give them away.

Both are complete.  Other tables are a parameter of the operators (see vispark.sources.rules).
"""

from __future__ import annotations

# Wrong phrase, right phrase, group, explanation.
PHRASES = (
    ("trãi", "trải", "hoi-nga", '"trãi" không phải từ tiếng Việt'),
    ("xãy", "xảy", "hoi-nga", '"xãy" không phải từ tiếng Việt'),
    ("sẳn", "sẵn", "hoi-nga", '"sẳn" không phải từ tiếng Việt'),
    ("hảy", "hãy", "hoi-nga", '"hảy" không phải từ tiếng Việt'),
    ("dỉ nhiên", "dĩ nhiên", "hoi-nga", 'từ Hán–Việt "dĩ" viết dấu ngã'),
    ("mổi", "mỗi", "hoi-nga", '"mỗi" viết dấu ngã'),
    ("chuẫn", "chuẩn", "hoi-nga", '"chuẩn" viết dấu hỏi'),
    ("cẫn thận", "cẩn thận", "hoi-nga", '"cẩn" viết dấu hỏi'),
    ("hiễu", "hiểu", "hoi-nga", '"hiểu" viết dấu hỏi'),
    ("dể", "dễ", "hoi-nga", '"dễ" viết dấu ngã'),
    ("nghỉa", "nghĩa", "hoi-nga", '"nghĩa" viết dấu ngã'),
    ("kỹ niệm", "kỷ niệm", "hoi-nga", '"kỷ" (ghi nhớ) viết dấu hỏi'),
    ("kỹ luật", "kỷ luật", "hoi-nga", '"kỷ" (phép tắc) viết dấu hỏi'),
    ("thế kỹ", "thế kỷ", "hoi-nga", '"kỷ" (đơn vị thời gian) viết dấu hỏi'),
    ("kỷ thuật", "kỹ thuật", "hoi-nga", '"kỹ" (khéo, tinh) viết dấu ngã'),
    ("kỷ năng", "kỹ năng", "hoi-nga", '"kỹ" (khéo, tinh) viết dấu ngã'),
    ("kỷ lưỡng", "kỹ lưỡng", "hoi-nga", '"kỹ" (khéo, tinh) viết dấu ngã'),
    ("kỷ sư", "kỹ sư", "hoi-nga", '"kỹ" (khéo, tinh) viết dấu ngã'),
    ("nổ lực", "nỗ lực", "hoi-nga", '"nỗ" là gắng sức; "nổ" là phát nổ'),
    ("chia sẽ", "chia sẻ", "hoi-nga", '"sẻ" là san bớt; "sẽ" chỉ thì tương lai'),
    ("san sẽ", "san sẻ", "hoi-nga", '"sẻ" là san bớt cho người khác'),
    ("suy nghỉ", "suy nghĩ", "hoi-nga", '"nghĩ" là tư duy; "nghỉ" là ngừng làm việc'),
    ("sữa chữa", "sửa chữa", "hoi-nga", '"sửa" là làm lại cho đúng; "sữa" là đồ uống'),
    ("sữa chửa", "sửa chữa", "hoi-nga", "cả hai âm tiết đều sai dấu"),
    ("sửa chửa", "sửa chữa", "hoi-nga", '"chữa" viết dấu ngã'),
    ("bỗ sung", "bổ sung", "hoi-nga", '"bổ" viết dấu hỏi'),
    ("đãm bảo", "đảm bảo", "hoi-nga", '"đảm" viết dấu hỏi'),
    ("đảm bão", "đảm bảo", "hoi-nga", '"bảo" viết dấu hỏi'),
    ("vẽ vang", "vẻ vang", "hoi-nga", '"vẻ" (dáng vẻ) viết dấu hỏi'),
    ("giã sử", "giả sử", "hoi-nga", '"giả" (giả định) viết dấu hỏi'),
    ("lảng phí", "lãng phí", "hoi-nga", '"lãng" viết dấu ngã'),
    ("rỏ ràng", "rõ ràng", "hoi-nga", '"rõ" viết dấu ngã'),
    ("vội vả", "vội vã", "hoi-nga", '"vã" viết dấu ngã'),
    ("dử dội", "dữ dội", "hoi-nga", '"dữ" viết dấu ngã'),
    ("giử gìn", "giữ gìn", "hoi-nga", '"giữ" viết dấu ngã'),
    ("bải bỏ", "bãi bỏ", "hoi-nga", '"bãi" viết dấu ngã'),
    ("cãi thiện", "cải thiện", "hoi-nga", '"cải" (thay đổi) viết dấu hỏi'),
    ("cải nhau", "cãi nhau", "hoi-nga", '"cãi" (tranh luận) viết dấu ngã'),
    ("tranh cải", "tranh cãi", "hoi-nga", '"cãi" (tranh luận) viết dấu ngã'),
    ("cải vã", "cãi vã", "hoi-nga", '"cãi" (tranh luận) viết dấu ngã'),
    ("hổ trợ", "hỗ trợ", "hoi-nga", '"hỗ" (giúp nhau) viết dấu ngã'),
    ("hổn loạn", "hỗn loạn", "hoi-nga", '"hỗn" viết dấu ngã'),
    ("hỗ thẹn", "hổ thẹn", "hoi-nga", '"hổ" (xấu hổ) viết dấu hỏi'),
    ("quãng cáo", "quảng cáo", "hoi-nga", '"quảng" (rộng) viết dấu hỏi'),
    ("quảng đường", "quãng đường", "hoi-nga", '"quãng" (đoạn) viết dấu ngã'),
    ("khoãng", "khoảng", "hoi-nga", '"khoảng" viết dấu hỏi'),
    ("mảnh liệt", "mãnh liệt", "hoi-nga", '"mãnh" (mạnh) viết dấu ngã'),
    ("mãnh vỡ", "mảnh vỡ", "hoi-nga", '"mảnh" (miếng) viết dấu hỏi'),
    ("mạnh mẻ", "mạnh mẽ", "hoi-nga", '"mẽ" viết dấu ngã'),
    ("dủng cảm", "dũng cảm", "hoi-nga", '"dũng" viết dấu ngã'),
    ("ũng hộ", "ủng hộ", "hoi-nga", '"ủng" viết dấu hỏi'),
    ("hưỡng", "hưởng", "hoi-nga", '"hưởng" viết dấu hỏi'),
    ("ảnh hưỡng", "ảnh hưởng", "hoi-nga", '"hưởng" viết dấu hỏi'),
    ("nổi buồn", "nỗi buồn", "hoi-nga", '"nỗi" (cảm xúc) viết dấu ngã'),
    ("nổi đau", "nỗi đau", "hoi-nga", '"nỗi" (cảm xúc) viết dấu ngã'),
    ("nổi nhớ", "nỗi nhớ", "hoi-nga", '"nỗi" (cảm xúc) viết dấu ngã'),
    ("nổi lo", "nỗi lo", "hoi-nga", '"nỗi" (cảm xúc) viết dấu ngã'),
    ("nổi sợ", "nỗi sợ", "hoi-nga", '"nỗi" (cảm xúc) viết dấu ngã'),
    ("nổi niềm", "nỗi niềm", "hoi-nga", '"nỗi" (cảm xúc) viết dấu ngã'),
    ("nỗi tiếng", "nổi tiếng", "hoi-nga", '"nổi" (trội lên) viết dấu hỏi'),
    ("nỗi bật", "nổi bật", "hoi-nga", '"nổi" (trội lên) viết dấu hỏi'),
    ("nỗi dậy", "nổi dậy", "hoi-nga", '"nổi" (trội lên) viết dấu hỏi'),
    ("nỗi loạn", "nổi loạn", "hoi-nga", '"nổi" (trội lên) viết dấu hỏi'),
    ("nỗi giận", "nổi giận", "hoi-nga", '"nổi" (trội lên) viết dấu hỏi'),
    ("cỗ vũ", "cổ vũ", "hoi-nga", '"cổ" viết dấu hỏi'),
    ("cổ máy", "cỗ máy", "hoi-nga", '"cỗ" (bộ, chiếc) viết dấu ngã'),
    ("cơn bảo", "cơn bão", "hoi-nga", '"bão" (thời tiết) viết dấu ngã'),
    ("bảo táp", "bão táp", "hoi-nga", '"bão" (thời tiết) viết dấu ngã'),
    ("bão vệ", "bảo vệ", "hoi-nga", '"bảo" (giữ gìn) viết dấu hỏi'),
    ("bão đảm", "bảo đảm", "hoi-nga", '"bảo" (giữ gìn) viết dấu hỏi'),
    ("bão hiểm", "bảo hiểm", "hoi-nga", '"bảo" (giữ gìn) viết dấu hỏi'),
    ("bão dưỡng", "bảo dưỡng", "hoi-nga", '"bảo" (giữ gìn) viết dấu hỏi'),
    ("chán nãn", "chán nản", "hoi-nga", '"nản" viết dấu hỏi'),
    ("nãn lòng", "nản lòng", "hoi-nga", '"nản" viết dấu hỏi'),
    ("buồn bả", "buồn bã", "hoi-nga", '"bã" viết dấu ngã'),
    ("vất vã", "vất vả", "hoi-nga", '"vả" viết dấu hỏi'),
    ("mệt mõi", "mệt mỏi", "hoi-nga", '"mỏi" viết dấu hỏi'),
    ("thoãi mái", "thoải mái", "hoi-nga", '"thoải" viết dấu hỏi'),
    ("kiên nhẩn", "kiên nhẫn", "hoi-nga", '"nhẫn" viết dấu ngã'),
    ("nhẩn nại", "nhẫn nại", "hoi-nga", '"nhẫn" viết dấu ngã'),
    ("có lẻ", "có lẽ", "hoi-nga", '"lẽ" (lí lẽ) viết dấu ngã'),
    ("lẻ ra", "lẽ ra", "hoi-nga", '"lẽ" (lí lẽ) viết dấu ngã'),
    ("điều chĩnh", "điều chỉnh", "hoi-nga", '"chỉnh" viết dấu hỏi'),
    ("chân trọng", "trân trọng", "ch-tr", '"trân" (quý) viết tr'),
    ("trân thành", "chân thành", "ch-tr", '"chân" (thật) viết ch'),
    ("chân quý", "trân quý", "ch-tr", '"trân" (quý) viết tr'),
    ("bắt trước", "bắt chước", "ch-tr", '"chước" viết ch, không liên quan "trước/sau"'),
    ("chăn trở", "trăn trở", "ch-tr", '"trăn trở" viết tr'),
    ("chăn chở", "trăn trở", "ch-tr", '"trăn trở" viết tr'),
    ("che trở", "che chở", "ch-tr", '"chở" ở đây là che chắn, viết ch'),
    ("chót lọt", "trót lọt", "ch-tr", '"trót lọt" viết tr'),
    ("chuyên trở", "chuyên chở", "ch-tr", '"chở" (vận chuyển) viết ch'),
    ("trau truốt", "trau chuốt", "ch-tr", '"chuốt" viết ch'),
    ("chở thành", "trở thành", "ch-tr", '"trở" (biến thành) viết tr'),
    ("chung thành", "trung thành", "ch-tr", '"trung" (giữa, thẳng) viết tr'),
    ("tre chở", "che chở", "ch-tr", '"che chở" viết ch cả hai âm tiết'),
    ("suất sắc", "xuất sắc", "s-x", '"xuất" (ra, vượt) viết x'),
    ("sơ xuất", "sơ suất", "s-x", '"suất" ở đây viết s'),
    ("xử dụng", "sử dụng", "s-x", '"sử" (dùng) viết s'),
    ("sử lý", "xử lý", "s-x", '"xử" (giải quyết) viết x'),
    ("sử lí", "xử lí", "s-x", '"xử" (giải quyết) viết x'),
    ("suất hiện", "xuất hiện", "s-x", '"xuất" (ra) viết x'),
    ("suất phát", "xuất phát", "s-x", '"xuất" (ra) viết x'),
    ("suất khẩu", "xuất khẩu", "s-x", '"xuất" (ra) viết x'),
    ("sản suất", "sản xuất", "s-x", '"xuất" (ra) viết x'),
    ("xúc tích", "súc tích", "s-x", '"súc" (chứa đựng) viết s'),
    ("cọ sát", "cọ xát", "s-x", '"xát" (chà) viết x'),
    ("sắc xảo", "sắc sảo", "s-x", '"sảo" ở đây viết s'),
    ("xoi mói", "soi mói", "s-x", '"soi" viết s'),
    ("sáng lạn", "xán lạn", "s-x", 'từ đúng là "xán lạn" (rực rỡ)'),
    ("sáng lạng", "xán lạn", "s-x", 'từ đúng là "xán lạn" (rực rỡ)'),
    ("che dấu", "che giấu", "d-gi-r", '"giấu" (giữ kín) viết gi; "dấu" là vết tích'),
    ("dấu diếm", "giấu giếm", "d-gi-r", '"giấu giếm" viết gi cả hai âm tiết'),
    ("giấu diếm", "giấu giếm", "d-gi-r", '"giếm" viết gi'),
    ("giấu vết", "dấu vết", "d-gi-r", '"dấu" (vết tích) viết d'),
    ("dành giật", "giành giật", "d-gi-r", '"giành" (tranh lấy) viết gi'),
    ("tranh dành", "tranh giành", "d-gi-r", '"giành" (tranh lấy) viết gi'),
    ("để giành", "để dành", "d-gi-r", '"dành" (cất giữ) viết d'),
    ("giành dụm", "dành dụm", "d-gi-r", '"dành" (cất giữ) viết d'),
    ("dục giã", "giục giã", "d-gi-r", '"giục" (thúc) viết gi'),
    ("hoàng toàng", "hoàn toàn", "n-ng", "cả hai âm tiết kết thúc bằng n"),
    ("lãng mạng", "lãng mạn", "n-ng", '"mạn" kết thúc bằng n'),
    ("nhất quáng", "nhất quán", "n-ng", '"quán" kết thúc bằng n'),
    ("chính chắn", "chín chắn", "n-ng", '"chín" (đủ độ) kết thúc bằng n'),
    ("thăm quan", "tham quan", "tu-vung", '"tham quan" nghĩa là xem tận nơi'),
    ("chuẩn đoán", "chẩn đoán", "tu-vung", '"chẩn" (xem bệnh), không phải "chuẩn"'),
    ("vô hình chung", "vô hình trung", "tu-vung", 'thành ngữ đúng là "vô hình trung"'),
    ("tựu chung", "tựu trung", "tu-vung", 'thành ngữ đúng là "tựu trung"'),
    ("nhận chức", "nhậm chức", "tu-vung", '"nhậm chức" là nhận nhiệm vụ chức quan'),
    ("sát nhập", "sáp nhập", "tu-vung", '"sáp" (cắm vào) mới đúng'),
    ("chín mùi", "chín muồi", "tu-vung", 'từ đúng là "chín muồi"'),
    ("bạc mạng", "bạt mạng", "tu-vung", 'từ đúng là "bạt mạng"'),
    ("đường xá", "đường sá", "tu-vung", '"sá" trong "đường sá" viết s'),
    ("bàng quang", "bàng quan", "tu-vung", '"bàng quan" là thờ ơ; "bàng quang" là bọng đái'),
    ("yếu điểm", "điểm yếu", "tu-vung", '"yếu điểm" nghĩa là điểm quan trọng, không phải nhược điểm'),
    ("nghành", "ngành", "chinh-ta", '"ngh" chỉ đứng trước e, ê, i'),
    ("í kiến", "ý kiến", "chinh-ta", '"ý" viết bằng y'),
)

# Group, then two forms, each with its gloss, whether it is strict, and the words before and behind that point to it.
PAIRS = (
    (
        "hoi-nga",
        ("nửa", "một phần hai", False,
            ("một", "quá", "gần", "đúng", "chia", "mất"),
            ("tiếng", "giờ", "ngày", "đêm", "đường", "chừng", "vời", "năm", "kia", "phần", "buổi", "đời", "chặng")),
        ("nữa", "thêm, tiếp tục", False,
            ("lần", "thêm", "còn", "không", "gì", "đâu", "ai", "nào", "chút", "ít", "tí"),
            ("là", "thì", "rồi", "đi", "nhé", "thôi", "chứ")),
    ),
    (
        "hoi-nga",
        ("nghỉ", "ngừng làm việc", False,
            ("được", "xin", "ngày", "kỳ", "kì", "tạm", "cho", "nghỉ"),
            ("ngơi", "học", "việc", "hưu", "phép", "mát", "lễ", "trưa", "ốm", "giải", "tay", "chân")),
        ("nghĩ", "tư duy", False,
            ("suy", "ngẫm", "đang", "thử", "cứ"),
            ("rằng", "về", "ra", "đến", "kỹ", "ngợi", "bụng", "thầm", "lại", "sao", "mà")),
    ),
    (
        "hoi-nga",
        ("sửa", "làm lại cho đúng", False,
            ("đi", "mang", "cần", "phải", "đem", "thợ", "tiệm", "chỉnh"),
            ("chữa", "xe", "lỗi", "bài", "đổi", "sang", "soạn", "nhà", "máy", "lại", "chính")),
        ("sữa", "đồ uống từ bò, mẹ", False,
            ("hộp", "ly", "cốc", "uống", "bột", "hũ", "bịch", "ống", "bú"),
            ("tươi", "chua", "bò", "mẹ", "đặc", "công", "ong", "tắm", "rửa", "bột")),
    ),
    (
        "hoi-nga",
        ("bảo", "giữ gìn, dặn dò", False,
            ("che", "ai", "người", "mẹ", "đã", "anh", "chị"),
            ("vệ", "đảm", "hiểm", "tồn", "quản", "trì", "dưỡng", "mật", "lãnh", "ban", "rằng", "là")),
        ("bão", "thời tiết dữ dội", False,
            ("cơn", "trận", "siêu", "mùa", "sau", "trước"),
            ("táp", "lũ", "số", "tố", "đổ", "bộ", "lụt", "hòa", "giật")),
    ),
    (
        "hoi-nga",
        ("cũ", "không mới", False,
            ("đồ", "bạn", "người", "xe", "nhà", "quần", "áo", "sách", "máy", "chuyện"),
            ("kỹ", "kĩ", "mới", "rích", "càng")),
        ("củ", "phần rễ cây", False,
            ("một", "vài", "mấy", "luộc", "gọt"),
            ("khoai", "cải", "hành", "tỏi", "gừng", "nghệ", "sắn", "riềng", "cà")),
    ),
    (
        "hoi-nga",
        ("mở", "làm cho không đóng", False,
            ("đã", "vừa", "cần", "hãy", "đang", "chưa"),
            ("cửa", "ra", "đầu", "rộng", "màn", "khóa", "lời", "đường", "bài", "quán", "mang")),
        ("mỡ", "chất béo", False,
            ("thịt", "miếng", "lớp", "nhiều", "béo", "dầu"),
            ("lợn", "màng", "bụng", "heo", "gan", "hành", "máu")),
    ),
    (
        "hoi-nga",
        ("đổ", "làm tràn, sụp", False,
            ("làm", "bị", "xô", "sụp", "sập"),
            ("nước", "vỡ", "xăng", "máu", "mồ", "nát", "bộ", "lỗi", "dồn")),
        ("đỗ", "dừng lại, thi đạt", False,
            ("thi", "chỗ", "bãi", "hạt", "đậu", "điểm"),
            ("xe", "đạt", "xanh", "đen", "tương", "đại", "trượt")),
    ),
    (
        "hoi-nga",
        ("rảnh", "không bận", False,
            ("lúc", "khi", "đang", "hơi", "được", "thời", "nào"),
            ("rỗi", "tay", "rang", "việc")),
        ("rãnh", "đường lõm dài", False,
            ("cái", "con", "đường", "một", "đào"),
            ("nước", "thoát", "mương", "sâu")),
    ),
    (
        "hoi-nga",
        ("lỡ", "bỏ mất, trót", False,
            ("bị", "đã", "chẳng", "may", "nhỡ"),
            ("hẹn", "tay", "dở", "chuyến", "làng", "thì", "miệng", "mất", "lời")),
        ("lở", "sạt, loét", False,
            ("sạt", "đất", "bị", "núi"),
            ("đất", "loét", "núi", "bờ", "mồm")),
    ),
    (
        "hoi-nga",
        ("hũ", "đồ đựng", False,
            ("cái", "một", "chiếc", "trong"),
            ("gạo", "rượu", "mắm", "đựng", "tương", "vàng")),
        ("hủ", 'cũ nát — chỉ dùng trong "hủ tục, hủ hóa, hủ nho"', True,
            (),
            ("tục", "hóa", "lậu", "nho", "bại")),
    ),
    (
        "hoi-nga",
        ("vẻ", "dáng, bề ngoài", False,
            ("dáng", "có", "ra", "phong", "đầy", "làm"),
            ("đẹp", "mặt", "ngoài", "vang", "duyên", "như", "buồn")),
        ("vẽ", "tạo hình bằng nét", False,
            ("bức", "đang", "biết", "tập", "hình", "học"),
            ("tranh", "hình", "vời", "đồ", "bản", "họa", "bậy")),
    ),
    (
        "hoi-nga",
        ("cũng", "từ nối, biểu thị tương đồng", False,
            (),
            ()),
        ("củng", 'chỉ dùng trong "củng cố"', True,
            (),
            ("cố",)),
    ),
    (
        "hoi-nga",
        ("đã", "chỉ thì quá khứ", False,
            (),
            ()),
        ("đả", 'đánh — chỉ dùng trong "đả kích, đả đảo, đả thương"', True,
            (),
            ("kích", "đảo", "thương", "phá", "động")),
    ),
    (
        "hoi-nga",
        ("ngủ", "trạng thái nghỉ", False,
            (),
            ()),
        ("ngũ", 'năm — chỉ dùng trong "ngũ cốc, đội ngũ, ngã ngũ"', True,
            ("ngã", "đội", "đấu", "hàng"),
            ("cốc", "quan", "hành", "vị", "sắc")),
    ),
    (
        "hoi-nga",
        ("vẫn", "tiếp tục như trước", False,
            (),
            ()),
        ("vẩn", 'đục — chỉ dùng trong "vẩn đục, vẩn vơ"', True,
            (),
            ("đục", "vơ")),
    ),
    (
        "hoi-nga",
        ("lãng", "buông thả, hoang phí", False,
            (),
            ("phí", "mạn", "quên", "du", "tử")),
        ("lảng", 'né tránh — "lảng tránh, nói lảng"', True,
            ("nói", "lấp"),
            ("tránh", "vảng")),
    ),
    (
        "hoi-nga",
        ("dở", "không tốt, chưa xong", False,
            ("hơi", "quá", "rất", "khóc"),
            ("dang", "tệ", "khóc", "chứng", "ẹ", "òm", "hơi")),
        ("dỡ", 'tháo xuống — "dỡ hàng, tháo dỡ"', True,
            ("tháo", "bốc"),
            ("hàng", "xuống", "nhà", "bỏ")),
    ),
    (
        "d-gi-r",
        ("dành", "cất giữ, để riêng cho", False,
            ("để", "ưu", "phần", "riêng"),
            ("thời", "gian", "dụm", "riêng", "tặng", "cho", "sẵn", "lại")),
        ("giành", "tranh lấy về mình", False,
            ("tranh", "đi", "cùng"),
            ("chiến", "thắng", "giật", "lấy", "quyền", "độc", "giải", "ngôi", "huy")),
    ),
    (
        "ch-tr",
        ("chuyện", "sự việc, lời kể", False,
            ("câu", "kể", "nói", "trò", "có", "những", "mọi", "vụ"),
            ("gì", "này", "đó", "ấy", "riêng", "tình", "cũ", "lạ")),
        ("truyện", "tác phẩm viết ra", False,
            ("đọc", "cuốn", "quyển", "viết", "tập", "bộ", "xem"),
            ("tranh", "ngắn", "cổ", "tích", "dài", "kiếm", "ma")),
    ),
    (
        "d-gi-r",
        ("dở", "không tốt, chưa xong", False,
            ("hơi", "quá", "rất"),
            ("dang", "tệ", "ẹ", "òm")),
        ("giở", 'mở ra, bày ra — "giở sách, giở trò"', True,
            (),
            ("sách", "trang", "trò", "ra", "vở", "sổ")),
    ),
)
